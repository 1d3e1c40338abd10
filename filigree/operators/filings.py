"""Filing metadata, facts and market series as relational operators over all tickers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.chunking import key_sections

#: Labels of 8-K items, matched as a whole string.
EVENT_LABELS = {
    "1.01": "Bankruptcy/Receivership", "2.01": "Asset Acquisition/Disposal", "2.02": "Results & Financials", "2.03": "Material Impairments",
    "3.01": "Material Agreements", "4.01": "Accountant Changes", "5.01": "Change in Control", "5.02": "Executive/Director Changes",
    "5.07": "Bankruptcy/Receivership", "7.01": "Major Announcement (Reg FD)", "8.01": "Other Significant Events",
}
#: Revenue concepts in order of preference.
REVENUE = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet")


def recent(submissions: DataFrame) -> DataFrame:
    """(ticker, pos, form, accession, date, document, item) from parallel arrays, cut to the shortest of the first four."""
    arrays = ["form", "accessionNumber", "filingDate", "primaryDocument"]
    n = F.least(*[F.size(a) for a in arrays])
    rows = submissions.select("ticker", F.posexplode(F.slice(F.arrays_zip(*arrays, "items"), F.lit(1), n)).alias("pos", "x"))
    return rows.select("ticker", "pos", F.col("x.form").alias("form"), F.col("x.accessionNumber").alias("accession"), F.col("x.filingDate").alias("date"), F.col("x.primaryDocument").alias("document"), F.coalesce("x.items", F.lit("")).alias("item"))


def first_of(rows: DataFrame, keep: Column, count: int, key: str = "ticker", pos: str = "pos") -> DataFrame:
    """The first `count` rows of each key, in filing order, that keep holds for."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return rows.where(keep).withColumn("place", place).where(F.col("place") <= count)


def of_types(form: Column, types: list[str]) -> Column:
    """Substring match: 10-K finds 10-K/A too."""
    out = F.lit(False)
    for t in types:
        out = out | F.contains(form, F.lit(t))
    return out


def since(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days) if days > 0 else F.lit("1900-01-01").cast("date")


def event_label(item: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in EVENT_LABELS.items() for x in p])[item], F.lit("Corporate Event"))


def while_recent(rows: DataFrame, old: Column, count: int, key: str = "ticker", pos: str = "pos") -> DataFrame:
    """Rows of each key in filing order up to the first old one, `count` at most."""
    run = Window.partitionBy(key).orderBy(pos)
    seen = F.sum(old.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("seen", seen).withColumn("place", F.row_number().over(run)).where((F.col("seen") == 0) & (F.col("place") <= count)).drop("seen")


def yearly_growth(facts: DataFrame) -> DataFrame:
    """(ticker, concept, value, period, yoy_growth) of the last period from (ticker, concept, end, pos, val); growth against the row before in order of (end, pos), in percent.

    A previous value of zero has no growth: the whole result of that ticker is null, as is a single row's growth.
    """
    order = Window.partitionBy("ticker", "concept").orderBy(F.desc("end"), "pos")
    rows = facts.withColumn("prev", F.lead("val").over(order)).withColumn("r", F.row_number().over(order)).where("r = 1")
    bad = F.max((F.col("prev") == 0).cast("int")).over(Window.partitionBy("ticker")) == 1
    growth = F.round(F.try_divide(F.col("val") - F.col("prev"), F.col("prev")) * 100, 2)
    return rows.select("ticker", "concept", F.when(~F.coalesce(bad, F.lit(False)), F.col("val")).alias("value"), F.col("end").alias("period"), F.when(~F.coalesce(bad, F.lit(False)), growth).alias("yoy_growth"))


def preferred(rows: DataFrame, concepts: list[str]) -> DataFrame:
    """The rows of each ticker's first concept in the list that has any."""
    place = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    best = F.min(place).over(Window.partitionBy("ticker"))
    return rows.where(F.col("concept").isin(list(concepts))).withColumn("best", best).where(F.col("best") == place).drop("best")


def facts_of(company_facts: DataFrame) -> DataFrame:
    """(ticker, concept, unit, pos, val, end, form) from nested facts; us-gaap, or ifrs-full where that is empty."""
    gaap, ifrs = F.col("facts.us-gaap"), F.col("facts.ifrs-full")
    rows = company_facts.select("ticker", F.explode(F.when(F.size(gaap) > 0, gaap).otherwise(ifrs)).alias("concept", "c"))
    rows = rows.select("ticker", "concept", F.explode("c.units").alias("unit", "x"))
    return rows.select("ticker", "concept", "unit", F.posexplode("x").alias("pos", "v")).select("ticker", "concept", "unit", "pos", "v.val", "v.end", "v.form")


def moving_average(column: str, n: int, key: str = "ticker", by: str = "ts") -> Column:
    """Mean of the last n rows; null until there are n."""
    w = Window.partitionBy(key).orderBy(by).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w))


def with_cik(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows with cik: ten digits of the first company whose ticker equals in any case, else null. companies: (pos, ticker, cik_str)."""
    first = companies.groupBy(F.lower("ticker").alias("low")).agg(F.min_by("cik_str", "pos").alias("cik_str"))
    return rows.join(first, F.lower(rows["ticker"]) == first["low"], "left").withColumn("cik", F.lpad(F.col("cik_str").cast("string"), 10, "0")).drop("low", "cik_str")


def earnings(rows: DataFrame, periods: dict[str, str], count: int = 2) -> DataFrame:
    """The first `count` rows of each ticker whose form is one of periods (form -> period) in full, with period."""
    named = F.create_map(*[F.lit(x) for p in periods.items() for x in p])[F.col("form")]
    return first_of(rows, named.isNotNull(), count).withColumn("period", named).drop("place")


def latest_report(rows: DataFrame, types: list[str]) -> DataFrame:
    """The first row of each ticker of these types (amended ones too) that has a text, with its key sections."""
    first = first_of(rows, of_types(F.col("form"), types), 1).drop("place")
    return first.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("sections", key_sections(F.col("text")))
