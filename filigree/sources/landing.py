"""Readers of landed files with fixed schemas, and writers of results. Live services are out of scope: land their replies first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "struct<item:string,title:string,text:string,start:long,end:long,n_chars:long>"
FILING = f"ticker string, filing_type string, filing_date string, url string, n_chars_full long, sections map<string,{SECTION}>"
CASE = "id string, question string, ticker string, relevant_doc_ids array<string>, must_include array<string>, should_refuse boolean, tags array<string>, note string"
SUBMISSIONS = "ticker string, form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>, items array<string>"
FACTS = "ticker string, facts map<string,map<string,struct<units:map<string,array<struct<val:double,end:string,form:string>>>>>>"


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of cached filings (one JSON file a ticker, or one file), by ticker and start; an error if there are none."""
    rows = spark.read.schema(FILING).json(path, multiLine=True)
    rows = rows.select("ticker", "filing_type", "filing_date", "url", F.explode(F.map_entries("sections")).alias("s"))
    doc_id = F.concat_ws("-", "ticker", "filing_type", "filing_date", F.concat(F.lit("item"), F.lower("s.value.item")))
    out = rows.select(doc_id.alias("doc_id"), "ticker", "filing_type", "filing_date", "s.value.item", "s.value.title", "s.value.text", "url", "s.value.start")
    if out.isEmpty():
        raise FileNotFoundError(f"no sections in {path}")
    return out.orderBy("ticker", "start")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions (JSON lines); blank lines are skipped, missing lists are empty; an error on a line without id or question."""
    empty = F.array().cast("array<string>")
    rows = spark.read.schema(CASE).json(path)
    need = F.when(F.col("id").isNull() | F.col("question").isNull(), F.raise_error(F.lit("a case lacks id or question"))).otherwise(F.col("id"))
    return rows.select(need.alias("id"), "question", "ticker", *[F.coalesce(c, empty).alias(c) for c in ("relevant_doc_ids", "must_include")], F.coalesce("should_refuse", F.lit(False)).alias("should_refuse"), F.coalesce("tags", empty).alias("tags"), "note")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path)


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path)


def tickers(text: str) -> list[str]:
    return [t.strip().upper() for t in text.split(",") if t.strip()]


def latest_indicator(rows: DataFrame) -> DataFrame:
    """(ticker, indicator, date, value) of the largest date key from (ticker, indicator, series: map)."""
    one = rows.select("ticker", "indicator", F.explode("series").alias("date", "value"))
    return one.groupBy("ticker", "indicator").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def write_json(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small result as a Markdown table."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()])
