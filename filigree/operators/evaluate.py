"""Retrieval metrics over (got, relevant) arrays, generation checks, abstention thresholds. Undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions import text as T


def recall(got: Column, relevant: Column, k: int) -> Column:
    rel = F.array_distinct(relevant)
    return F.when(F.size(rel) > 0, F.size(F.array_intersect(F.slice(got, 1, k), rel)) / F.size(rel))


def precision(got: Column, relevant: Column, k: int) -> Column:
    """Repeats count; the denominator is the real length of the window; 0 for none."""
    if k <= 0:
        return F.lit(0.0)
    window = F.slice(got, 1, k)
    return F.when(F.size(window) > 0, F.size(F.filter(window, lambda x: F.array_contains(relevant, x))) / F.size(window)).otherwise(0.0)


def hit(got: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(F.array_intersect(F.slice(got, 1, k), relevant)) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(got: Column, relevant: Column) -> Column:
    first = F.array_min(F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull()))
    return F.coalesce(1 / first, F.lit(0.0))


def ndcg(got: Column, relevant: Column, k: int) -> Column:
    """Only the first place of each relevant document gains; 0 where the ideal is 0."""
    window, rel = F.slice(got, 1, k), F.array_distinct(relevant)
    gains = F.transform(window, lambda x, i: F.when(F.array_contains(rel, x) & (F.array_position(window, x) == i + 1), 1 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(max(1, k))), F.lit(1), F.least(F.size(rel), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    return F.when(ideal > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / ideal).otherwise(0.0)


def purity(tickers: Column, expected: Column, k: int) -> Column:
    window = F.slice(tickers, 1, k)
    return F.when(expected.isNotNull() & (F.size(window) > 0), F.size(F.filter(window, lambda t: t == expected)) / F.size(window))


def nearest_rank(rows: DataFrame, by: str, column: str, share: float) -> DataFrame:
    """(by, value): the value at place floor(share * n) of each key, at most the last. Values are counted first, and no key's are held in one row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(by)
    upto = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(own))
    place = F.least(F.floor(share * F.col("all")), F.col("all") - 1)
    return placed.where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)).select(by, "value")


def calibration_curve(scores: DataFrame, ratio: float = 5.0) -> DataFrame:
    """(threshold, missed, false_refusals, cost) from (answerable, score): null score means no hit.

    Thresholds are the distinct scores to two digits. Errors come from counts of scores below each threshold,
    one sorted pass over distinct scores, not from scores times thresholds.
    """
    s = F.col("score")
    base = scores.agg(F.sum((~F.col("answerable")).cast("int")).alias("out_all"), F.sum((F.col("answerable") & s.isNull()).cast("int")).alias("no_hit"))
    steps = scores.where(s.isNotNull()).select(F.round("score", 2).alias("threshold")).distinct()
    rows = scores.where(s.isNotNull()).select(s.alias("at"), F.lit(0).alias("is_step"), F.col("answerable").cast("int").alias("inside"), (~F.col("answerable")).cast("int").alias("outside"))
    rows = rows.union(steps.select("threshold", F.lit(-1), F.lit(0), F.lit(0)))
    # One row a distinct score and kind: at most as many as distinct scores.
    small = rows.groupBy("at", "is_step").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    below = Window.orderBy("at", "is_step").rowsBetween(Window.unboundedPreceding, 0)
    run = small.select("at", "is_step", F.sum("inside").over(below).alias("in_below"), F.sum("outside").over(below).alias("out_below")).where("is_step = -1")
    all_out = scores.where(s.isNotNull()).agg(F.coalesce(F.sum((~F.col("answerable")).cast("int")), F.lit(0)).alias("out_scored"))
    out = run.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(all_out))
    missed, false = F.col("out_scored") - F.col("out_below"), F.col("in_below") + F.col("no_hit")
    return out.select(F.col("at").alias("threshold"), missed.alias("missed"), false.alias("false_refusals"), (missed * ratio + false).alias("cost"))


def chosen(curve: DataFrame) -> DataFrame:
    return curve.orderBy("cost", "false_refusals", "threshold").limit(1)


def budgeted(hits: DataFrame, budget: int = 2000) -> DataFrame:
    """Hits (qid, rank, text) while the sum of costs, a quarter of the length and at least 1, stays within budget; adds cost and used."""
    cost = F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int"))
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("cost", cost).withColumn("used", F.sum("cost").over(run)).where(F.col("used") <= budget)


def assembled(hits: DataFrame) -> DataFrame:
    """(qid, context): `[n] (citation)` and the text of each hit, in rank order, blank lines between."""
    part = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("citation"), F.lit(")\n"), F.col("text")).alias("part"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("context"))


def extractive_answer(texts: Column) -> Column:
    """The first 300 characters of the first three texts, each with its mark; the refusal for none."""
    from filigree.functions.text import REFUSAL, collapsed

    parts = F.transform(F.slice(texts, 1, 3), lambda t, i: F.concat(F.substring(collapsed(t), 1, 300), F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    return F.when(F.size(texts) > 0, F.array_join(parts, "\n\n")).otherwise(REFUSAL)


def ticker_consistency(tickers: Column, expected: Column) -> Column:
    """Struct: distinct tickers in order, mixed, ok (nothing expected, or exactly the expected one)."""
    names = F.array_sort(F.array_distinct(tickers))
    return F.struct(names.alias("tickers"), (F.size(names) > 1).alias("mixed"), (expected.isNull() | F.coalesce(names == F.array(expected), F.lit(False))).alias("ok"))


def score_ranges(scores: DataFrame) -> DataFrame:
    """One row from (answerable, score), a null score being below all others: the ranges of both kinds, whether a threshold parts them, by how much they overlap."""
    at, inside = F.coalesce("score", F.lit(float("-inf"))), F.col("answerable")
    ends = scores.agg(*[f(F.when(kind, at)).alias(n) for n, f, kind in (("in_low", F.min, inside), ("in_high", F.max, inside), ("out_low", F.min, ~inside), ("out_high", F.max, ~inside))])
    shown = [F.round(c, 3).alias(c) for c in ends.columns]
    return ends.select(*shown, F.coalesce(F.col("in_low") > F.col("out_high"), F.lit(True)).alias("separable"), F.round(F.col("out_high") - F.col("in_low"), 3).alias("overlap"))


def answer_checks(rows: DataFrame) -> DataFrame:
    """rows (answer, context, must_include, should_refuse, n_sources, tickers, asked) with the checks of each answer and whether it passes.

    A question that is out of scope passes by a refusal. Any other passes if the context holds the facts, the context has
    every figure, the marks name sources, and the sources are those of the company asked about (if one was).
    """
    facts = lambda text: T.all_included(F.col(text), F.col("must_include"))
    out = rows.withColumn("contains_required", facts("answer")).withColumn("context_contains", facts("context"))
    out = out.withColumn("numeric_grounded", F.size(T.unsupported_numbers(F.col("answer"), F.col("context"))) == 0)
    out = out.withColumn("citations_ok", T.citation_check(F.col("answer"), F.col("n_sources"))["ok"])
    out = out.withColumn("ticker_ok", F.col("asked").isNull() | (F.array_distinct("tickers") == F.array("asked")))
    fine = F.col("context_contains") & F.col("numeric_grounded") & F.col("citations_ok") & F.col("ticker_ok")
    return out.withColumn("passed", F.when(F.col("should_refuse"), T.is_refusal(F.col("answer"))).otherwise(fine))


def generation_rates(checked: DataFrame) -> DataFrame:
    """One row: the share of answers that pass, and of each check among the questions in scope."""
    share = lambda c, name: F.round(F.avg(c.cast("double")), 3).alias(name)
    in_scope = lambda c: F.when(~F.col("should_refuse"), F.col(c))
    kinds = (("contains_required", "contains_required_rate"), ("context_contains", "context_contains_rate"), ("numeric_grounded", "numeric_grounded_rate"), ("ticker_ok", "ticker_correct_rate"))
    return checked.agg(share(F.col("passed"), "pass_rate"), *[share(in_scope(c), n) for c, n in kinds], F.count("*").alias("n"))
