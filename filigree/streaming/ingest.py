"""Incremental ingest: new document files become postings; an extension, run by trigger(availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from filigree.operators import search


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_postings(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of new (ord, text) documents; each batch is written once under its number, so a rerun replaces it."""

    def batch(rows: DataFrame, number: int) -> None:
        search.postings(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
