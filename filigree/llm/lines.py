"""Repeated line runs found over the suffixes of line-ID sequences by prefix doubling; only DataFrame operations.

Every line has an ID (hash of the line). A suffix begins at each line that occurs twice or more; a stretch is a
row of such lines without a gap. A run is deleted where it has `words` words or more and an earlier copy.

No length is tried one by one. If a line lies in a run W with an earlier copy and `words` words, then it lies in a
part of W that is a shortest one with `words` words, counted forward from its first line or backward from its last:
the one that begins at the line, or the one that ends there, or, where neither fits into W, the last one forward that
fits into W, which then holds the line. So two parts a line, forward and backward, decide over runs of every length.
Equal parts are equal runs of lines, named by doubling: the names of the first and of the last 2^k lines, 2^k being
the largest power within the part, and its length. Doubling goes as far as the longest part.

Order: doc_id (null last), then hash of the text, then line. Null text: no lines, stays null. Empty text: one
empty line; a very long text is one sequence as any. Rows that repeat both doc_id and text share one fate, as one document. Empty table: empty
result. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import stored

WORDS = 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("filigree_k1", F.xxhash64("doc_id", "text")).withColumn("filigree_k2", F.xxhash64(F.lit(7), "doc_id", "text"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, pos, name, words): the lines that occur twice or more; repeated rows count once."""
    lines = keyed(docs).where("text is not null").select(F.col("filigree_k1").alias("k1"), F.col("filigree_k2").alias("k2"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("k1", "k2", "doc_id", "pos", F.xxhash64("line").alias("name"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    lines = stored(lines)
    # Written first, so that the join reads two plain shuffles, whose skewed partitions Spark can split: a line may be very common.
    twice = stored(lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    return lines.join(twice, "name")


def parts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(k1, k2, doc_id, pos, name, seg, ahead, back): for each repeated line the lengths of the shortest parts of `words` words that begin and that end there, null if none."""
    rows = repeated_lines(docs)
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(Window.partitionBy("k1", "k2").orderBy("pos")))
    stretch = Window.partitionBy("k1", "k2", "seg")
    rows = rows.withColumn("upto", F.sum("words").over(stretch.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words")).withColumn("ends", F.max("pos").over(stretch)).withColumn("starts", F.min("pos").over(stretch)).withColumn("total", F.max("upto").over(stretch))
    # The first line with so many words before it, from the stretch's end; the last one with so few up to it, from its start.
    beyond = F.min("pos").over(stretch.orderBy(-F.col("before")).rangeBetween(Window.unboundedPreceding, -words))
    below = F.max("pos").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -words))
    rows = rows.withColumn("beyond", beyond).withColumn("below", below)
    end = F.coalesce(F.col("beyond") - 1, F.when(F.col("total") - F.col("before") >= words, F.col("ends")))
    start = F.coalesce(F.col("below") + 1, F.when(F.col("upto") >= words, F.col("starts")))
    return rows.select("k1", "k2", "doc_id", "pos", "name", "seg", (end - F.col("pos") + 1).alias("ahead"), (F.col("pos") - start + 1).alias("back"))


def later_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(k1, k2, removed: line numbers) of documents with lines that repeat an earlier run."""
    rows = stored(parts(docs, words))
    longest = rows.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 1
    along = Window.partitionBy("k1", "k2", "seg").orderBy("pos")
    named, power = rows.withColumn("n0", F.col("name")), 0
    while 2 << power <= longest:
        named = named.withColumn(f"n{power + 1}", F.xxhash64(F.lit(power + 1), f"n{power}", F.lead(f"n{power}", 1 << power).over(along)))
        power += 1
    # The names of the parts that begin at a line and, 2^k - 1 lines on, end there.
    opens = F.array(*[F.col(f"n{k}") for k in range(power + 1)])
    closes = F.array(*[F.lag(f"n{k}", (1 << k) - 1).over(along) for k in range(power + 1)])
    named = named.select("k1", "k2", "doc_id", "pos", "ahead", "back", opens.alias("opens"), closes.alias("closes"))
    named = stored(named)
    other = named.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("pos").alias("at"), F.col("opens").alias("other_opens"), F.col("closes").alias("other_closes"))
    level = lambda n: F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
    ends = named.where("ahead is not null").withColumn("at", F.col("pos") + F.col("ahead") - 1)
    starts = named.where("back is not null").withColumn("at", F.col("pos") - F.col("back") + 1)
    met = lambda df: df.join(other.withColumnRenamed("at", "o_at").hint("merge"), (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")) & (F.col("at") == F.col("o_at")))
    ahead = met(ends).select("k1", "k2", "doc_id", "pos", F.lit(0).alias("way"), F.col("ahead").alias("size"), F.xxhash64(F.col("opens")[level(F.col("ahead"))], F.col("other_closes")[level(F.col("ahead"))]).alias("name"))
    back = met(starts).select("k1", "k2", "doc_id", F.col("at").alias("pos"), F.lit(1).alias("way"), F.col("back").alias("size"), F.xxhash64(F.col("other_opens")[level(F.col("back"))], F.col("closes")[level(F.col("back"))]).alias("name"))
    rows = stored(ahead.union(back))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "pos")
    first = rows.groupBy("way", "size", "name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    first = stored(first.select("way", "size", "name", "first"))  # for the same reason
    copies = rows.join(first, ["way", "size", "name"]).where(place != F.col("first"))
    spans = copies.select("k1", "k2", F.sequence("pos", F.col("pos") + F.col("size") - 1).alias("span")).distinct()
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("span")))).alias("removed"))


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the later copies of repeated runs taken out of text, and filigree_lines, filigree_removed: numbers of lines."""
    removed = stored(later_copies(docs, words)).withColumnsRenamed({"k1": "filigree_k1", "k2": "filigree_k2", "removed": "filigree_gone"})
    # removed grows with the documents: never broadcast, so the plan is the same at every size.
    out = keyed(docs).join(removed.hint("merge"), ["filigree_k1", "filigree_k2"], "left")
    lines = F.split("text", "\n", -1)
    # Each text is split once; what stays is a difference of sets, so the work is linear in the lines.
    stay = lambda l: F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("filigree_gone"))
    left = F.transform(F.array(lines), lambda l: F.array_join(F.transform(stay(l), lambda i: F.get(l, i)), "\n"))[0]
    columns = [F.when(F.col("filigree_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("filigree_lines"), F.coalesce(F.size("filigree_gone"), F.lit(0)).cast("long").alias("filigree_removed"))
