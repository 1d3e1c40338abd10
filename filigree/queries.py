"""Registered queries over the driver tables: documents stand for filings, benchmark items for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.functions import text as T
from filigree.operators import agent, chunking, evaluate, filings, search

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("source").alias("ticker"), F.col("lang").alias("item"))


def questions(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def scopes(spark, d) -> DataFrame:
    """A scope for every second question: one of the 20 sources."""
    q = questions(spark, d)
    return q.select("qid", F.when(F.col("qid") % 2 == 0, F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))).alias("scope"))


@query
def tokenize_stats(spark, d):
    rows = passages(spark, d).select("item", T.tokens(F.col("text")).alias("t"))
    return rows.groupBy("item").agg(F.count("*").alias("n"), F.sum(F.size("t")).cast("long").alias("tokens"), F.sum(F.size(F.array_distinct("t"))).cast("long").alias("distinct_tokens"), F.max(F.size("t")).alias("longest"))


@query
def tokenize_compounds(spark, d):
    rows = passages(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).where(F.col("term").rlike("[-&]"))
    return rows.groupBy("term").agg(F.count("*").alias("n"))


@query
def bm25_postings(spark, d):
    return search.postings(passages(spark, d)).groupBy("ord").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("max_tf"), F.max("dl").alias("dl"))


@query
def bm25_idf(spark, d):
    return search.idf(passages(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, d):
    return search.top(search.bm25(questions(spark, d), passages(spark, d)), 5)


def vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


def vector_queries(spark, d) -> DataFrame:
    return vectors(spark, d).where("ord % 20 = 0").select(F.col("ord").alias("qid"), "embedding", F.col("label").alias("scope"))


@query
def dense_topk(spark, d):
    return search.dense_top(vector_queries(spark, d), vectors(spark, d), 5)


@query
def dense_scoped_topk(spark, d):
    return search.dense_top(vector_queries(spark, d), vectors(spark, d), 5, same="label")


@query
def tfidf_sparse_topk(spark, d):
    return search.tfidf_top(questions(spark, d), passages(spark, d), 5)


@query
def rank_lists(spark, d):
    lists = search.rank_lists(questions(spark, d), passages(spark, d))
    return lists.select("qid", "ord", "bm25_rank", "tfidf_rank")


@query
def rrf_topk(spark, d):
    lists = search.fused(search.rank_lists(questions(spark, d), passages(spark, d)))
    return search.top(lists.select("qid", "ord", "score"), 5)


@query
def rrf_scoped_topk(spark, d):
    lists = search.fused(search.rank_lists(questions(spark, d), passages(spark, d)))
    return search.top(search.scoped(lists, scopes(spark, d)).select("qid", "ord", "ticker", "score"), 5)


@query
def ticker_resolve(spark, d):
    asked = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(F.col("role"), F.lit(" "), F.col("text")).alias("question"))
    names = read(spark, d, "nation").select(F.upper("n_name").alias("ticker")).union(spark.createDataFrame([("USER",), ("ASK",)], "ticker string"))
    return search.resolved(asked, names, {"ASSIST": "ASK", "SYSTEM": "NONE"})


@query
def lexical_rerank_topk(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    cut = search.top(search.bm25(q, p), 40).select("qid", "ord")
    rows = cut.join(q, "qid").join(p.select("ord", "text"), "ord")
    return search.top(search.overlap_scores(rows).select("qid", "ord", "score"), 5)


@query
def mmr_select(spark, d):
    near = search.dense_top(vector_queries(spark, d), vectors(spark, d), 40)
    return search.diversified(near.join(vectors(spark, d).select("ord", "embedding"), "ord"), 10)


def judged(spark, d) -> DataFrame:
    """(qid, tags, got, tickers, expected): neighbours of each query vector; all vectors of its label are relevant."""
    found = search.dense_top(vector_queries(spark, d), vectors(spark, d), 10).join(vectors(spark, d).select("ord", "label"), "ord")
    got = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "label"))).alias("x"))
    relevant = vectors(spark, d).groupBy("label").agg(F.array_sort(F.collect_list("ord")).alias("relevant"))
    rows = got.join(vector_queries(spark, d).select("qid", F.col("scope").alias("label")), "qid").join(relevant, "label")
    return rows.select("qid", F.col("label").alias("expected"), "relevant", F.transform("x", lambda r: r["ord"]).alias("got"), F.transform("x", lambda r: r["label"]).alias("labels"))


@query
def retrieval_metrics(spark, d):
    got, rel = F.col("got"), F.col("relevant")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return judged(spark, d).agg(
        *[mean(evaluate.recall(got, rel, k), f"recall_{k}") for k in (1, 3, 5)],
        *[mean(evaluate.hit(got, rel, k), f"hit_{k}") for k in (1, 3, 5)],
        mean(evaluate.precision(got, rel, 5), "precision_5"), mean(evaluate.reciprocal_rank(got, rel), "mrr"),
        mean(evaluate.ndcg(got, rel, 5), "ndcg_5"), mean(evaluate.purity(F.col("labels"), F.col("expected"), 5), "purity_5"), F.count("*").alias("n"),
    )


@query
def ndcg_per_query(spark, d):
    return judged(spark, d).select("qid", F.round(evaluate.ndcg(F.col("got"), F.col("relevant"), 5), 6).alias("ndcg"))


@query
def purity(spark, d):
    return judged(spark, d).select("qid", F.round(evaluate.purity(F.col("labels"), F.col("expected"), 5), 6).alias("purity"))


@query
def metrics_by_tag(spark, d):
    tags = F.array(F.concat(F.lit("label"), F.col("expected").cast("string")), F.when(F.col("qid") % 40 == 0, "even").otherwise("odd"))
    rows = judged(spark, d).select(F.explode(tags).alias("tag"), evaluate.hit(F.col("got"), F.col("relevant"), 5).alias("h"))
    return rows.groupBy("tag").agg(F.round(F.avg("h"), 6).alias("hit"), F.count("*").alias("n"))


@query
def latency_percentiles(spark, d):
    rows = read(spark, d, "events").select("event_type", "value")
    half = rows.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"))
    late = evaluate.nearest_rank(rows, "event_type", "value", 0.95).select("event_type", F.round("value", 6).alias("p95"))
    return half.join(late, "event_type", "left")


def hit_sets(spark, d) -> DataFrame:
    """(config, qid, tag, hit): whether a passage that holds the item's first eight words is among the top five."""
    q, p = questions(spark, d), passages(spark, d)
    lead = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("lead"))
    out = None
    for name, best in (("bm25", search.top(search.bm25(q, p), 5)), ("tfidf", search.tfidf_top(q, p, 5))):
        rows = best.join(p.select("ord", "text"), "ord").join(lead, "qid").groupBy("qid").agg(F.max(F.contains("text", F.col("lead")).cast("int")).alias("hit"))
        own = q.select("qid").join(rows, "qid", "left").select(F.lit(name).alias("config"), "qid", (F.col("qid") % 4).cast("string").alias("tag"), F.coalesce("hit", F.lit(0)).alias("hit"))
        out = own if out is None else out.union(own)
    return out


@query
def ablation_pivot(spark, d):
    rows = hit_sets(spark, d).groupBy("tag").pivot("config", ["bm25", "tfidf"]).agg(F.round(F.avg("hit"), 6))
    return rows


@query
def miss_set_ops(spark, d):
    missed = hit_sets(spark, d).where("hit = 0")
    a, b = (missed.where(F.col("config") == c).select("qid") for c in ("bm25", "tfidf"))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "qid")
    return kind(a.intersect(b), "both").union(kind(a.subtract(b), "bm25_only")).union(kind(b.subtract(a), "tfidf_only"))


@query
def label_validation(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    unknown = labels.select((F.col("doc_id") * 2).alias("doc_id")).join(docs, "doc_id", "left_anti").select("doc_id", F.lit("unknown document").alias("problem"))
    lacking = labels.join(docs, "doc_id").where(~T.all_included(F.col("text"), F.array(F.lit("THE"), F.lit(" the ")))).select("doc_id", F.lit("lacks a fact").alias("problem"))
    return unknown.union(lacking)


def abstention_scores(spark, d) -> DataFrame:
    q = questions(spark, d)
    best = search.top(search.bm25(q, passages(spark, d)), 1).select("qid", F.round(F.col("score") / 20, 4).alias("score"))
    return q.join(best, "qid", "left").select("qid", (F.col("qid") % 3 != 0).alias("answerable"), F.when(F.col("qid") % 11 != 0, F.col("score")).alias("score"))


@query
def calibration_curve(spark, d):
    return evaluate.calibration_curve(abstention_scores(spark, d))


@query
def calibration_choice(spark, d):
    return evaluate.chosen(evaluate.calibration_curve(abstention_scores(spark, d)))


@query
def calibration_ranges(spark, d):
    return evaluate.score_ranges(abstention_scores(spark, d))


def plain_docs(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.col("source"), F.lit(" 10-K - Item "), F.col("lang"), F.lit(". ")).alias("prefix"))


@query
def word_window_chunks(spark, d):
    return chunking.word_windows(plain_docs(spark, d), 100, 10).select("id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def legacy_chunks(spark, d):
    return chunking.word_windows(plain_docs(spark, d), 100, 10, early_stop=False).select("id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def chunk_stats(spark, d):
    docs = plain_docs(spark, d)
    rows = chunking.word_windows(docs).select(F.lit("word_window").alias("strategy"), "text").union(chunking.section_chunks(docs).select(F.lit("section_aware"), "text"))
    n = F.length("text")
    return rows.groupBy("strategy").agg(F.count("*").alias("chunks"), F.floor(F.sum(n) / F.count("*")).cast("long").alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


@query
def paragraph_split(spark, d):
    rows = plain_docs(spark, d).select("id", T.paragraphs(F.col("text")).alias("p"))
    return rows.select("id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("p", "|")).alias("digest"))


@query
def hard_split(spark, d):
    rows = plain_docs(spark, d).select("id", F.posexplode(chunking.hard_split(T.collapsed(F.col("text")), 300)).alias("part", "piece"))
    return rows.select("id", "part", F.length("piece").alias("n_chars"), F.md5("piece").alias("digest"))


@query
def section_aware_chunks(spark, d):
    return chunking.section_chunks(plain_docs(spark, d)).select("id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


#: Items of made-up filings: a table of contents, then bodies.
CONTENTS = ("1", "1A", "1B", "1C", "2", "3", "5", "7", "7A", "8")


def made_filings(spark, d) -> DataFrame:
    """A filing for each document: a dense table of contents, filler, then the document under four headings."""
    contents = " ".join(f"Item {k}. Title" for k in CONTENTS)
    body = F.regexp_replace("text", r"\s+", " ")
    parts = [F.lit(contents), F.lit(" "), F.repeat(F.lit("filler "), 400)]
    for k in ("1", "1A", "7", "8"):
        parts += [F.lit(f" Item {k}. "), body, F.lit(" "), F.repeat(F.lit("more "), 300)]
    return read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(*parts).alias("text"))


@query
def toc_density_filter(spark, d):
    rows = chunking.headings(made_filings(spark, d))
    kept = chunking.without_contents(rows)
    return rows.groupBy("id").agg(F.count("*").alias("found")).join(kept.groupBy("id").agg(F.count("*").alias("kept"), F.min("pos").alias("first")), "id", "left").select("id", "found", F.coalesce("kept", F.lit(0)).alias("kept"), "first")


@query
def section_spans(spark, d):
    return chunking.sections(made_filings(spark, d)).select("id", "item", "title", "start", "end", "n_chars")


@query
def legacy_sections(spark, d):
    texts = made_filings(spark, d).select("id", F.replace(F.replace("text", F.lit("Item 1. "), F.lit("Item 1. Business ")), F.lit("Item 1A. "), F.lit("Item 1A. Risk Factors ")).alias("text"))
    s = texts.select("id", chunking.key_sections(F.col("text")).alias("s"))
    return s.select("id", *[F.coalesce(F.length(F.col("s")[k]), F.lit(0)).alias(k) for k in ("business", "risks", "md_and_a")])


def ranked_hits(spark, d) -> DataFrame:
    found = search.top(search.bm25(questions(spark, d), passages(spark, d)), 5)
    return found.join(passages(spark, d), "ord").withColumn("citation", F.concat_ws(" ", "ticker", "item"))


@query
def context_budget(spark, d):
    return evaluate.budgeted(ranked_hits(spark, d)).select("qid", "rank", "ord", "cost", "used")


@query
def context_assembly(spark, d):
    rows = evaluate.assembled(evaluate.budgeted(ranked_hits(spark, d)))
    return rows.select("qid", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def answers(spark, d) -> DataFrame:
    """(id, answer, context): each turn of a conversation as an answer over the turn before; marks and figures are put in by rule."""
    c = read(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    marked = F.concat("text", F.lit(". Revenue was $"), F.col("conv_id").cast("string"), F.lit(",5"), F.col("turn").cast("string"), F.lit(".2% ["), (F.col("turn") % 5).cast("string"), F.lit("]. Done [1]."))
    answer = F.when(F.col("id") % 7 == 0, T.REFUSAL).when(F.col("id") % 11 == 0, F.col("text")).when(F.col("id") % 13 == 0, F.lit("<your answer>")).otherwise(marked)
    before = F.concat(F.col("text"), F.lit(" "), (F.col("conv_id") - F.col("turn") % 2).cast("string"), F.lit("5"), F.col("turn").cast("string"), F.lit(".2"))
    return c.select("id", "conv_id", "turn", "role", answer.alias("answer"), before.alias("context"))


def judged_answers(spark, d) -> DataFrame:
    """Answers with what they are held against, put in by rule."""
    rows = answers(spark, d)
    tickers = F.when(F.col("turn") % 3 == 0, F.array(F.col("role"), F.lit("other"))).otherwise(F.array("role"))
    asked = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return evaluate.answer_checks(rows.select("id", "answer", "context", F.array(F.lit("the"), F.lit("IN")).alias("must_include"), (F.col("id") % 6 == 0).alias("should_refuse"), F.lit(3).alias("n_sources"), tickers.alias("tickers"), asked.alias("asked")))


@query
def answer_checks(spark, d):
    return judged_answers(spark, d).select("id", "contains_required", "context_contains", "numeric_grounded", "citations_ok", "ticker_ok", "passed")


@query
def generation_metrics(spark, d):
    return evaluate.generation_rates(judged_answers(spark, d))


@query
def numeric_grounding(spark, d):
    rows = answers(spark, d).select("id", T.unsupported_numbers(F.col("answer"), F.col("context")).alias("u"))
    return rows.select("id", F.array_join("u", ",").alias("unsupported"), (F.size("u") == 0).alias("ok"))


@query
def citation_check(spark, d):
    rows = answers(spark, d).select("id", T.citation_check(F.col("answer"), F.lit(3)).alias("c"))
    return rows.select("id", F.array_join("c.invalid", ",").alias("invalid"), "c.cited_share", "c.ok")


@query
def ticker_consistency(spark, d):
    rows = ranked_hits(spark, d).groupBy("qid").agg(F.collect_list("ticker").alias("t")).join(scopes(spark, d), "qid")
    c = evaluate.ticker_consistency(F.col("t"), F.col("scope"))
    return rows.select("qid", c.alias("c")).select("qid", F.array_join("c.tickers", ",").alias("tickers"), "c.mixed", "c.ok")


@query
def refusal_flag(spark, d):
    return answers(spark, d).select("id", T.is_refusal(F.col("answer")).alias("refused"))


@query
def must_include(spark, d):
    return read(spark, d, "documents").select("doc_id", T.all_included(F.col("text"), F.array(F.lit("The"), F.lit("IN"))).alias("ok"))


@query
def extractive_answers(spark, d):
    rows = evaluate.budgeted(ranked_hits(spark, d)).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("t"))
    return questions(spark, d).select("qid").join(rows, "qid", "left").select("qid", F.md5(evaluate.extractive_answer(F.coalesce("t", F.array().cast("array<string>")))).alias("digest"))


def feed(spark, d) -> DataFrame:
    """Orders as filings of customers: newest first."""
    form = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 5 == 0, "/A").otherwise(""))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), form.alias("form"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("key"), "o_totalprice")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"), "key")))


@query
def filing_topn(spark, d):
    return filings.first_of(feed(spark, d), filings.of_types(F.col("form"), ["1-URGENT", "2-HIGH"]), 2).select("ticker", "form", "date", "key")


@query
def earnings_filings(spark, d):
    found = filings.earnings(feed(spark, d), {"1-URGENT": "quarterly", "2-HIGH": "annual"})
    return found.select("ticker", "form", "date", "key", "period")


@query
def latest_report(spark, d):
    """Documents as filings of their source, of the form lang, the largest doc_id first."""
    rows = read(spark, d, "documents").select(F.col("source").alias("ticker"), F.col("lang").alias("form"), F.col("doc_id").alias("key"), (-F.col("doc_id")).alias("pos"), "text")
    found = filings.latest_report(rows, ["en", "d"])
    return found.select("ticker", "form", "key", F.length("text").alias("n_chars"), *[F.coalesce(F.length(F.col("sections")[k]), F.lit(0)).alias(k) for k in ("business", "risks", "md_and_a")])


AS_OF = "1998-08-02"


@query
def event_feed(spark, d):
    rows = feed(spark, d).where(F.col("date") >= filings.since(F.lit(AS_OF).cast("date"), 900))
    rows = filings.first_of(rows, F.col("form") == "1-URGENT", 3)
    code = F.concat((F.col("key") % 9).cast("string"), F.lit(".0"), (F.col("key") % 3).cast("string"))
    return rows.select("ticker", "date", "key", filings.event_label(code).alias("event"), F.datediff(F.lit(AS_OF).cast("date"), "date").alias("days_ago"))


@query
def take_while_recent(spark, d):
    rows = feed(spark, d).where("form = '3-MEDIUM'")
    return filings.while_recent(rows, F.col("date") < filings.since(F.lit(AS_OF).cast("date"), 900), 5).select("ticker", "date", "key", "place")


def facts(spark, d) -> DataFrame:
    """Yearly totals of each customer and order status as reported facts."""
    rows = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("concept"), F.year("o_orderdate").alias("end"))
    return rows.agg(F.round(F.sum("o_totalprice"), 2).alias("val")).withColumn("pos", F.col("end"))


@query
def yoy_growth(spark, d):
    return filings.yearly_growth(facts(spark, d))


@query
def concept_priority(spark, d):
    return filings.preferred(facts(spark, d).groupBy("ticker", "concept").agg(F.max("end").alias("period")), ["P", "F", "O"])


def bars(spark, d) -> DataFrame:
    rows = read(spark, d, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("ts"))
    return rows.agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"))


@query
def sma_rolling(spark, d):
    return bars(spark, d).select("ticker", "ts", F.round(filings.moving_average("close", 5), 6).alias("sma5"), F.round(filings.moving_average("close", 20), 6).alias("sma20"))


@query
def market_snapshot(spark, d):
    rows = bars(spark, d).withColumn("sma5", F.round(filings.moving_average("close", 5), 6))
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("close", "high", "low", "volume", "sma5", "ts"), "ts").alias("x"))
    zone = F.when((F.col("x.close") > 30) & (F.col("x.close") < 70), "neutral").otherwise("extreme")
    return last.select(F.upper("ticker").alias("ticker"), F.round("x.close", 6).alias("price"), F.round("x.high", 6).alias("day_high"), F.round("x.low", 6).alias("day_low"), "x.volume", "x.sma5", zone.alias("zone"))


@query
def latest_key(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").groupBy("event_type").agg(F.max_by(k, F.struct("ts", "event_id")).alias("k"), F.max("event_id").alias("last_id"))


def calls(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.concat("role", F.lit(":"), (F.length("text") % 3).cast("string")).alias("call"), (F.length("text") % 4 == 0).alias("failed"))


@query
def repeat_call_guard(spark, d):
    return agent.repeats(calls(spark, d), "conv_id", ["call"], "turn").select("conv_id", "turn", "call", "repeated")


@query
def error_budget(spark, d):
    rows = agent.error_budget(calls(spark, d), "conv_id", F.col("failed"), "turn", budget=1)
    return rows.select("conv_id", "turn", F.col("errors_before").cast("long").alias("errors_before"), "stopped")


@query
def degenerate_answers(spark, d):
    return answers(spark, d).select("id", T.is_degenerate(F.col("answer")).alias("degenerate"))


@query
def truncate_output(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), 2000)).alias("digest"))


@query
def cik_lookup(spark, d):
    companies = read(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.upper(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("ticker"), F.col("s_suppkey").alias("cik_str"))
    asked = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("ticker"))
    return filings.with_cik(asked, companies).select("c_custkey", "cik")


@query
def filing_urls(spark, d):
    accession = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-24-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return read(spark, d, "orders").select("o_orderkey", T.filing_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), accession, F.lit("doc.htm")).alias("url"))


@query
def available_tickers(spark, d):
    return passages(spark, d).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
