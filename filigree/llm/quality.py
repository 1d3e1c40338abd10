"""Quality classifier: hashed word n-gram logistic regression (see linear), labels from labels.quality.

Rows without doc_id are scored like any other; their held_out flag is null. A null text counts as empty.
Without a labelled row every score is 0.5, and nothing is rejected by kept().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import fold, labelled_sample
from filigree.llm.linear import ROWS, Linear, trained

THRESHOLD = 0.7


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Linear:
    """A model of labels.quality from at most `rows` labelled documents outside the held-out fold (crc32 mod 4 = 2)."""
    marked = labels.select("doc_id", F.col("quality").alias("y"))
    return trained(labelled_sample(docs, marked, rows, fold(4) != 2))


def quality(docs: DataFrame, model: Linear) -> DataFrame:
    """docs with a column filigree_score (0 to 1, higher is better)."""
    return docs.withColumn("filigree_score", model.scores(docs.sparkSession, F.col("text"))[0])


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under the threshold."""
    model = fitted(docs, labels)
    if not model.rows:
        return docs
    return quality(docs, model).where(F.col("filigree_score") >= threshold).drop("filigree_score")
