"""Retrieval configurations, from plain vectors to the full pipeline, and the plan each one builds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import search


@dataclass(frozen=True)
class Config:
    name: str
    chunker: str = "section_aware"
    retrieval: str = "hybrid"  # bm25, dense or hybrid
    candidates: int = 40
    rerank: bool = False
    diversify: bool = False
    top_k: int = 5
    scope: bool = False
    abstain_below: float | None = None
    options: dict = field(default_factory=dict)


#: The configurations that are compared, each with one more part than the one before.
LADDER = (
    Config("V0", chunker="word_window", retrieval="dense", top_k=3, options={"size": 500, "overlap": 50}),
    Config("V1", retrieval="dense"),
    Config("V2"),
    Config("V3", rerank=True),
    Config("V4", rerank=True, diversify=True, scope=True, abstain_below=0.30),
)
DIAGNOSTICS = tuple(Config(f"{r} only" if r != "hybrid" else "hybrid RRF", retrieval=r, candidates=5) for r in ("dense", "bm25", "hybrid"))


def hits(config: Config, questions: DataFrame, passages: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(config, qid, ord, ticker, score, stage, rank, abstain) of one configuration for all questions; without vectors from a model, dense is hashed TF-IDF."""
    lists = search.rank_lists(questions, passages)
    scored = {"bm25": lambda: lists.withColumn("score", F.col("bm25")), "dense": lambda: lists.withColumn("score", F.col("tfidf"))}.get(config.retrieval, lambda: search.fused(lists))()
    if config.scope and scope is not None:
        scored = search.scoped(scored, scope)
    cut = search.top(scored.select("qid", "ord", "ticker", "score"), max(config.candidates, config.top_k))
    stage = config.retrieval
    if config.rerank:
        texts = cut.join(passages.select("ord", "text"), "ord").join(questions, "qid")
        if config.diversify:
            cut_ids = search.diversified(_sparse_as_dense(texts), max(config.top_k, 10))
            texts = texts.join(cut_ids.select("qid", "ord"), ["qid", "ord"], "left_semi")
        texts = search.overlap_scores(texts.withColumnRenamed("rank", "before"))
        cut = search.top(texts.select("qid", "ord", "ticker", "score", "before"), config.top_k, "before")
        stage = "rerank"
    out = cut.where(F.col("rank") <= config.top_k).select(F.lit(config.name).alias("config"), "qid", "ord", "ticker", "score", F.lit(stage).alias("stage"), "rank")
    best = questions.select("qid").join(out.groupBy("qid").agg(F.max("score").alias("best")), "qid", "left")
    # A question without hits keeps a row of its own: it abstains wherever the configuration can.
    low = F.col("best").isNull() if config.abstain_below is None else F.coalesce(F.col("best") < config.abstain_below, F.lit(True))
    rows = best.select("qid", low.alias("abstain")).join(out, "qid", "left")
    return rows.select(F.lit(config.name).alias("config"), "qid", "ord", "ticker", "score", F.coalesce("stage", F.lit(stage)).alias("stage"), "rank", "abstain")


def _sparse_as_dense(candidates: DataFrame) -> DataFrame:
    """Candidates with a small dense vector of their hashed tokens, for the similarity between candidates only."""
    from filigree.functions.text import plain_tokens

    hashed = F.transform(F.array_distinct(plain_tokens(F.col("text"))), lambda t: F.pmod(F.xxhash64(t), F.lit(128)))
    v = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda b: F.size(F.filter(hashed, lambda h: h == b)).cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return candidates.select("qid", "ord", "score", "rank", F.transform(v, lambda x: x / length).alias("embedding"))
