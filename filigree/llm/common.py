"""What the corpus operators share: scratch tables, bounded samples, batches, connected components."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one in local mode (tests), else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="filigree-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filigree-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    if path := getattr(df, "_scratch", None):
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch, in the form of Spark's settings.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH in this session; Spark's own bounds, 10000 rows and 64 MB, let one batch hold all of a task's texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def released() -> None:
    """Gives the memory that this Python process has freed back to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """run, a function of batches, with released() once a task has ended: Spark keeps Python workers, with all they hold, for later tasks."""

    def whole(batches):
        yield from run(batches)
        released()

    return whole


def fold(mod: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the decimal doc_id, modulo mod; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, keep: Column | None = None) -> DataFrame:
    """At most `rows` labelled documents, those of the smallest hash of doc_id, joined with their text.

    labels has doc_id and a column y; repeated labels of a document count once (the largest y).
    The sample's ids are at most `rows`, so sending them to every task is bounded.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    if keep is not None:
        ids = ids.where(keep)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")


def slices(batches, column: str, most: int = 4 << 20):
    """Cuts Arrow batches so that each part has about `most` bytes of `column`, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node reachable; only nodes with a link appear.

    Alternating large-star and small-star rounds, each a group-by and a join over links, written to the
    shared folder. Every round keeps a spanning set of links, so their number never grows; rounds go on until one
    changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = stored(large.where(a != b).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = stored(small.where(a != b).distinct())
        dropped(now)
        dropped(large)
        now = small
    leaves = now.groupBy(a.alias("node")).agg(F.min("b").alias("root"))
    return leaves.union(now.select(b.alias("node"), b.alias("root")).distinct())


def per_text(work: Callable[[], Callable[[list], pa.Array]], returns: str):
    """A column function of one text column: work() is called once a task and gives a function of a list of texts."""

    def scored(parts):
        import numpy as np
        import pyarrow.compute as pc

        each = work()
        for part in parts:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(part), 0), dtype=np.int64))
            start, got = 0, []
            while start < len(part):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (2 << 20), side="right")))
                got.append(each(part.slice(start, stop - start).to_pylist()))
                start = stop
            yield pa.concat_arrays(got) if got else each([])

    @F.arrow_udf(returns)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from frugal(scored)(parts)

    return run


class WordIds(dict):
    """word -> what make(word) gives; forgets everything at `most` words, so that memory stays bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.make(word)
        return found
