"""Ranked retrieval: inverted index, hashed TF-IDF, dense vectors, fusion, scope, re-ranking, diversification.

Questions are rows (qid, question, ...), passages rows (ord, text, ticker, ...); every function scores all
questions in one plan. Scores are rounded to six digits before ranking, ties go to the lower ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import plain_tokens, tokens

K1, B, DIM, RRF_K = 1.5, 0.75, 1024, 60
#: Question vectors that go to every task at once; more questions take more passes.
BLOCK = 4096


def postings(passages: DataFrame) -> DataFrame:
    """(ord, term, tf, dl); dl counts all tokens of the passage."""
    # Lengths are taken below the explode: beside it they would be computed again for each token.
    rows = passages.select("ord", tokens(F.col("text")).alias("t")).select("ord", "t", F.size("t").alias("dl"))
    # The outer form, as Spark puts a filter on the size of t below the plain one, which makes the tokens once more.
    rows = rows.select("ord", "dl", F.explode_outer("t").alias("term")).where("term is not null")
    return rows.groupBy("ord", "term", "dl").agg(F.count("*").alias("tf")).select("ord", "term", "tf", "dl")


def corpus_stats(passages: DataFrame) -> DataFrame:
    """One row (n, avgdl); passages without tokens count with length 0."""
    return passages.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(term, df) from one row (terms: array) a passage. A passage sends each of its terms once, and counts are added up before the shuffle."""
    return terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def counted(rows: DataFrame) -> DataFrame:
    """(term, df) of rows (passage, term, tf); reads tf, so that it shares the shuffle of rows with whoever reads them, too."""
    return rows.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def idf_of(df, n) -> F.Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(passages: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms."""
    df = document_frequencies(passages.select(tokens(F.col("text")).alias("terms")))
    n = passages.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf_of(F.col("df"), F.col("n")).alias("idf"))


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, ord, score) of passages that share a term with the question. Only postings of question terms are kept."""
    asked = question_terms(questions)
    rows = postings(passages).join(asked.select("term").distinct(), "term", "left_semi")
    known = counted(rows).crossJoin(F.broadcast(corpus_stats(passages))).select("term", "avgdl", idf_of(F.col("df"), F.col("n")).alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = rows.join(known, "term").select("term", "ord", (F.col("idf") * weight).alias("w"))
    return found.join(asked, "term").groupBy("qid", "ord").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))


def bucket(term) -> F.Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % DIM).cast("int")


def tfidf_weights(rows: DataFrame, idfs: DataFrame) -> DataFrame:
    """(id, bucket, w) from (id, term, tf) and (term, idf, place: its bucket); unknown terms have idf 1."""
    w = (1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))
    return rows.join(idfs, "term", "left").groupBy("id", F.coalesce("place", bucket(F.col("term"))).alias("bucket")).agg(F.sum(w).alias("w"))


def tfidf_parts(questions: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weights of the questions and of the passages."""
    term_rows = lambda df, i, c: df.select(F.col(i).alias("id"), F.explode(plain_tokens(F.col(c))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = F.broadcast(passages.agg(F.count("*").alias("n")))
    weighed = lambda df: df.crossJoin(n).select("term", bucket(F.col("term")).alias("place"), (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    asked, rows = term_rows(questions, "qid", "question"), term_rows(passages, "ord", "text")
    terms = document_frequencies(passages.select(plain_tokens(F.col("text")).alias("terms")))
    return tfidf_weights(asked, weighed(terms)), tfidf_weights(rows, weighed(counted(rows)))


def unit_length(parts: DataFrame) -> DataFrame:
    length = parts.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return parts.join(length, "id").select("id", "bucket", (F.col("w") / (F.col("len") + 1e-12)).alias("w"))


def tfidf_scores(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, ord, score): cosine of hashed TF-IDF vectors, as a join on buckets; pairs without a common bucket have none."""
    left, right = map(unit_length, tfidf_parts(questions, passages))
    left = left.select(F.col("id").alias("qid"), "bucket", F.col("w").alias("qw"))
    return left.join(right.withColumnRenamed("id", "ord"), "bucket").groupBy("qid", "ord").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))


def tfidf_top(questions: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(qid, ord, score, rank): the k best of tfidf_scores for each question, without its rows of all pairs.

    Question vectors go to the tasks in blocks of BLOCK; a passage is one row of at most DIM buckets, and a task keeps
    the k best of each batch, so k rows a question and batch are shuffled.
    """
    asked, parts = tfidf_parts(questions, passages)
    sparse = lambda df: df.groupBy("id").agg(F.collect_list(F.struct("bucket", "w")).alias("v"))  # noqa: E731  at most DIM entries
    asked, found = sparse(asked), sparse(parts)
    return top(in_blocks(asked.withColumnRenamed("id", "qid"), "v", found.withColumnRenamed("id", "ord"), matched(k)), k)


def top(scores: DataFrame, k: int, *ties: str, by: str = "qid") -> DataFrame:
    """The k best rows of each question, with rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *(ties or ("ord",)))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_lists(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, ord, ticker, bm25, tfidf, bm25_rank, tfidf_rank): every passage has a rank in each list, those without a match after the others."""
    pairs = passages.select("ord", "ticker").crossJoin(F.broadcast(questions.select("qid")))
    a = bm25(questions, passages).withColumnRenamed("score", "bm25")
    b = tfidf_scores(questions, passages).withColumnRenamed("score", "tfidf")
    all_ = pairs.join(a, ["qid", "ord"], "left").join(b, ["qid", "ord"], "left").fillna(0.0, ["bm25", "tfidf"])
    place = lambda c: (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "ord")) - 1).alias(f"{c}_rank")
    return all_.select("*", place("bm25"), place("tfidf"))


def fused(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """lists with score: the sum of 1 / (k + rank + 1) over both lists; ranks are those of the whole corpus."""
    return lists.withColumn("score", F.round(1 / (k + F.col("bm25_rank") + 1) + 1 / (k + F.col("tfidf_rank") + 1), 9))


def scoped(scores: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows whose ticker is the question's scope; questions without scope keep all. Applied after fusion, before the cut."""
    return scores.join(scope.select("qid", "scope"), "qid", "left").where(F.col("scope").isNull() | (F.col("ticker") == F.col("scope"))).drop("scope")


def resolved(questions: DataFrame, tickers: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(qid, scope): the first ticker in order that stands as a word in the question, else the first alias in it whose ticker exists, else null.

    A question meets only tickers whose first run of word characters is one of its own (tickers without any: all questions).
    """
    up, run = F.upper("question"), r"[A-Za-z0-9_]+"
    names = tickers.select("ticker").distinct()
    keyed = names.withColumn("key", F.regexp_extract("ticker", run, 0))
    keys = F.array_distinct(F.concat(F.regexp_extract_all(up, F.lit(run), F.lit(0)), F.array(F.lit(""))))
    by_word = questions.select("qid", up.alias("up"), F.explode(keys).alias("key")).join(keyed, "key")
    by_word = by_word.where(F.rlike("up", F.concat(F.lit(r"\b\Q"), "ticker", F.lit(r"\E\b"))))
    found = by_word.select("qid", F.lit(0).alias("tier"), F.lit(0).alias("place"), "ticker")
    if aliases:
        rows = [(i, name, t) for i, (name, t) in enumerate(aliases.items())]
        known = questions.sparkSession.createDataFrame(rows, "place int, name string, ticker string").join(names, "ticker", "left_semi")
        by_alias = questions.join(F.broadcast(known), F.contains(up, F.col("name")))
        found = found.union(by_alias.select("qid", F.lit(1), "place", "ticker"))
    first = found.groupBy("qid").agg(F.min(F.struct("tier", "place", "ticker"))["ticker"].alias("scope"))
    return questions.select("qid").join(first, "qid", "left")


def lexical_overlap(question: F.Column, passage: F.Column) -> F.Column:
    """Of two token arrays, which must be columns made in a step before (else they are computed for each token):
    0.75 * share of question terms found + 0.25 * closeness of their places (0.5 for fewer than two places); 0 if either has no token."""
    q, d = question, passage
    places = F.filter(F.transform(d, lambda t, i: F.when(F.array_contains(q, t), i)), lambda i: i.isNotNull())
    share = F.size(F.array_intersect(q, d)) / F.size(q)
    near = F.when(F.size(places) >= 2, 1 / (1 + (F.array_max(places) - F.array_min(places)) / F.size(d))).otherwise(0.5)
    return F.when((F.size(q) == 0) | (F.size(d) == 0), 0.0).otherwise(0.75 * share + 0.25 * near)


def overlap_scores(rows: DataFrame) -> DataFrame:
    """rows (question, text, ...) with the lexical score, six digits."""
    rows = rows.withColumns({"_q": F.array_distinct(tokens(F.col("question"))), "_d": tokens(F.col("text"))})
    return rows.withColumn("score", F.round(lexical_overlap(F.col("_q"), F.col("_d")), 6)).drop("_q", "_d")


def best_of(ids, at, s, k: int):
    """An Arrow batch (qid, ord, score) of the k largest of each column of s (rows: at, columns: ids); ties to the lower of at, never a -inf."""
    import numpy as np
    import pyarrow as pa

    n = len(at)
    edge = np.partition(s, n - k, axis=0)[n - k] if n > k else -np.inf
    i, j = np.nonzero((s >= edge) & (s > -np.inf))
    order = np.lexsort((at[i], -s[i, j], j))
    i, j = i[order], j[order]
    first = np.arange(len(j)) - np.searchsorted(j, j) < k
    i, j = i[first], j[first]
    return pa.RecordBatch.from_arrays([pa.array(ids[j], pa.int64()), pa.array(at[i], pa.int64()), pa.array(s[i, j])], names=["qid", "ord", "score"])


def in_blocks(queries: DataFrame, column: str, rows: DataFrame, found, *also: str) -> DataFrame:
    """(qid, ord, score) of found(block, batches) for each block of the queries, (qid, column, *also), and rows (ord, column, ...)."""
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast([tuple(r) for r in own.select("qid", column, *also).orderBy("qid").collect()])  # about BLOCK vectors

        def run(batches, block=block):
            if block.value:
                yield from found(block.value, (x for x in batches if x.num_rows))

        part = rows.mapInArrow(run, "qid long, ord long, score double")
        parts = part if parts is None else parts.union(part)
    return parts


def matched(k: int):
    """What in_blocks runs on sparse vectors of nonnegative weights: cosines, six digits, of pairs with a common bucket."""

    def found(block, batches):
        import numpy as np

        q = np.zeros((len(block), DIM))
        for i, (_, v) in enumerate(block):
            for x in v:
                q[i, x["bucket"]] = x["w"]
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-12
        ids = np.array([r[0] for r in block])
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                v, at = part.column("v"), np.asarray(part.column("ord"))
                flat, m = v.flatten(), np.zeros((part.num_rows, DIM))
                m[np.repeat(np.arange(part.num_rows), np.asarray(v.value_lengths())), np.asarray(flat.field("bucket"))] = np.asarray(flat.field("w"))
                m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-12
                s = m @ q.T
                yield best_of(ids, at, np.where(s > 0, np.round(s, 6), -np.inf), k)

    return found


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(qid, ord, score, rank): the k nearest vectors by inner product for each query, exact.

    queries: (qid, embedding[, scope]), vectors: (ord, embedding[, same]). Query vectors go to the tasks in
    blocks of BLOCK; a task keeps the k best of each batch, so k rows a query and batch are shuffled. With
    `same`, only vectors whose column of that name equals the query's scope count.
    """

    def found(block, batches):
        import numpy as np

        ids, q = np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)
        scopes = np.array([r[2] for r in block]) if same else None
        for batch in batches:
            m = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            s = np.round(m @ q.T, 6)
            if same:
                s = np.where(np.asarray(batch.column(same).to_pylist())[:, None] == scopes[None, :], s, -np.inf)
            yield best_of(ids, np.asarray(batch.column("ord")), s, k)

    rows = vectors.select("ord", "embedding", *([same] if same else [])).where("embedding is not null")
    return top(in_blocks(queries, "embedding", rows, found, *(["scope"] if same else [])), k)


def diversified(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(qid, ord, place): greedy marginal relevance over (qid, ord, score, rank, embedding), at most a few dozen rows a question.

    Each step takes the row of the highest weight * score - (1 - weight) * largest similarity to those taken; the earlier rank wins ties.
    """

    def pick(group):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(np.asarray(group.column("rank")), kind="stable")
        rel = np.asarray(group.column("score"), dtype=float)[order]
        v = np.array(group.column("embedding").to_pylist(), dtype=float)[order]
        ords = np.asarray(group.column("ord"))[order]
        left, taken, worst = list(range(len(rel))), [], np.zeros(len(rel))
        while left and len(taken) < k:
            gains = [weight * rel[i] - (1 - weight) * (worst[i] if taken else 0.0) for i in left]
            i = left.pop(int(np.argmax(gains)))
            near = v @ v[i]
            worst = near if not taken else np.maximum(worst, near)
            taken.append(i)
        qid = pa.array(group.column("qid").to_pylist()[:1] * len(taken), group.column("qid").type)
        return pa.table({"qid": qid, "ord": ords[taken], "place": pa.array(range(1, len(taken) + 1), pa.int32())})

    kind = {c: candidates.schema[c].dataType.simpleString() for c in ("qid", "ord")}
    return candidates.groupBy("qid").applyInArrow(pick, f"qid {kind['qid']}, ord {kind['ord']}, place int")
