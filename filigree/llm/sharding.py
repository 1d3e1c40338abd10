"""Balanced label propagation of documents over shards; only DataFrame operations.

Documents are linked through hubs: those of one hub (by default, of equal text) are neighbours. Each linked
document starts in a shard by hash. In each round a hub's documents ask for the shard where most of their
neighbours are, of those with room; a shard takes requests in the order of a hash of hub and old shard while their
running sum is within its free rows, so linked documents gather and no request lifts a shard beyond its quota. All documents of one
hub and first shard move alike, so rounds are joins over (hub, first shard) rows, however large a hub is; a
hub larger than a shard fills one after another. Documents without neighbours then fill the gaps.

Law `rows`: shard sizes in rows differ by one at most. A distributed rank in the order of shards, with
single documents at both ends of each shard, is cut at the exact quotas, so that cuts fall on single ones.
Slots are gapless from 0 in each shard.

Null text: no bytes, linked with other null texts. Null doc_id or repeated rows: rows of their own. Empty
table: empty result. Other columns are ignored, or kept by laid_out(). The outcome is a function of the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import dropped, stored

SHARDS, ROUNDS, RANGES = 40, 6, 64
OVERHEAD = 16


def unit(*cols) -> Column:
    """A hash as a fraction in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def nodes(docs: DataFrame, hub: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, hashed, hub, first) of each document; first: where it starts."""
    text = F.col("text")
    out = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("hashed"),
        (hub if hub is not None else F.xxhash64(text)).alias("hub"),
    )
    return out.withColumn("first", F.pmod(F.xxhash64(F.lit(3), "doc_id", "hub"), F.lit(shards)).cast("int"))


def propagated(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked (hub, first, n) with shard: where the documents of a hub that started in first end up."""
    spark, shards = linked.sparkSession, len(quota)
    state = stored(linked.withColumn("shard", F.col("first")))
    rank = lambda s: F.struct("m", F.xxhash64("hub", s))  # noqa: E731  the most neighbours; ties by hash
    for turn in range(rounds):
        load = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # one row a shard
        room = [max(0, quota[s] - (load.get(s) or 0)) for s in range(shards)]
        there = state.groupBy("hub", "shard").agg(F.sum("n").alias("m")).withColumn("rank", rank("shard"))
        rooms = spark.createDataFrame(list(enumerate(room)), "shard int, room long")
        open_ = there.join(F.broadcast(rooms.where("room > 0")), "shard")
        target = open_.groupBy("hub").agg(F.max_by("shard", "rank").alias("to"), F.max("rank").alias("best"))
        asks = there.join(target.hint("merge"), "hub").where((F.col("shard") != F.col("to")) & (F.col("rank") < F.col("best"))).select("hub", "shard", "to", "m")
        asks = stored(asks)
        if asks.isEmpty():
            dropped(asks)
            break
        # The running sum of each target's requests, in RANGES ranges of their hash: no window holds all of them.
        order = F.xxhash64(F.lit(turn), "hub", "shard")
        asks = asks.withColumn("order", order).withColumn("range", F.shiftrightunsigned("order", 64 - (RANGES.bit_length() - 1)))
        sums = asks.groupBy("to", "range").agg(F.sum("m").alias("sum"))  # at most shards * RANGES rows
        before = sums.select("to", "range", (F.sum("sum").over(Window.partitionBy("to").orderBy("range")) - F.col("sum")).alias("before"))
        upto = F.sum("m").over(Window.partitionBy("to", "range").orderBy("order", "hub", "shard"))
        taken = asks.withColumn("upto", upto).join(F.broadcast(before), ["to", "range"])
        free = F.array(*map(F.lit, room))[F.col("to")]
        moves = taken.where(F.col("before") + F.col("upto") <= free).select("hub", "shard", "to").hint("merge")
        now = stored(state.join(moves, ["hub", "shard"], "left").select("hub", "first", "n", F.coalesce("to", "shard").alias("shard")))
        dropped(asks)
        dropped(state)
        state = now
    return state


def assigned(docs: DataFrame, hub: Column | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, hashed, law, shard, slot, grown_shard) for each document; hashed: of its text."""
    spark = docs.sparkSession
    found = stored(nodes(docs, hub, shards))
    total = found.count()
    low, more = divmod(total, shards)
    quota = [low + (s < more) for s in range(shards)]
    groups = found.groupBy("hub", "first").agg(F.count("*").alias("n"))
    many = groups.groupBy("hub").agg(F.sum("n").alias("all")).where("all > 1").select("hub")
    state = propagated(groups.join(many.hint("merge"), "hub"), quota, rounds)
    load = dict(state.groupBy("shard").agg(F.sum("n")).collect())
    room = [max(0, quota[s] - (load.get(s) or 0)) for s in range(shards)]
    reach, steps = 0, []
    for r in room:
        reach += r
        steps.append(reach / max(1, sum(room)))
    gap = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= unit(F.lit(11), "doc_id", "hub"))).cast("int")
    placed = found.join(state.select("hub", "first", F.col("shard").alias("at")).hint("merge"), ["hub", "first"], "left")
    side = F.when(F.col("at").isNotNull(), 1).otherwise(2 * F.pmod(F.xxhash64(F.lit(5), "doc_id", "hub"), F.lit(2)))
    placed = placed.withColumn("place", F.coalesce("at", F.least(gap, F.lit(shards - 1))))
    bits = F.xxhash64("doc_id", "text_crc32", "size")
    bucket = (F.col("place") * 3 + side) * RANGES + F.shiftrightunsigned(bits, 64 - (RANGES.bit_length() - 1))
    placed = placed.select("doc_id", "size", "text_crc32", "hashed", bits.alias("bits"), bucket.cast("long").alias("bucket"))
    placed = stored(placed)
    # At most shards * 3 * RANGES rows, whatever the input: one task adds them up, and every task may have them.
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("bits", "doc_id", "text_crc32", "size", "hashed")) - 1
    rank = F.col("rank")
    ranked = placed.withColumn("own", own).join(F.broadcast(before), "bucket").withColumn("rank", F.col("own") + F.col("before"))
    edge = more * (low + 1)
    shard = F.when(rank < edge, F.floor(rank / (low + 1))).otherwise(more + F.floor((rank - edge) / max(1, low)))
    slot = F.when(rank < edge, rank % (low + 1)).otherwise((rank - edge) % max(1, low))
    return ranked.select("doc_id", "size", "text_crc32", "hashed", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, hub: Column | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document."""
    return assigned(docs, hub, shards, rounds).drop("hashed")


def laid_out(docs: DataFrame, hub: Column | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The documents themselves in their shards: docs with size, text_crc32, law, shard, slot and grown_shard.

    A row finds its place by doc_id and the hash of its text; rows that have both in common take their places in the
    order of a hash of the whole row. Columns of docs that have one of these names give way to the new ones.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    places = stored(assigned(docs, hub, shards, rounds).select(F.col("doc_id").alias("placed_id"), "hashed", F.struct(*added).alias("place")))
    keys = stored(places.groupBy("placed_id", "hashed").agg(F.count("*").alias("n"), F.min("place").alias("place")))
    docs = docs.drop(*added)
    own = [docs[c] for c in docs.columns]
    same = docs["doc_id"].eqNullSafe(keys["placed_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["hashed"])
    once = docs.join(keys.where("n = 1"), same).select(*own, "place.*")
    repeated = keys.where("n > 1").select("placed_id", "hashed")
    if repeated.isEmpty():
        return once
    turn = lambda *by: F.row_number().over(Window.partitionBy("placed_id", "hashed").orderBy(*by))
    mine = docs.join(repeated, same).select(*own, "placed_id", "hashed", turn(F.xxhash64(*own)).alias("turn"))
    theirs = places.join(repeated.withColumnsRenamed({"placed_id": "one_id", "hashed": "one_hash"}), F.col("placed_id").eqNullSafe(F.col("one_id")) & (F.col("hashed") == F.col("one_hash")))
    theirs = theirs.select(F.col("placed_id").alias("its_id"), F.col("hashed").alias("its_hash"), "place", turn("place.shard", "place.slot").alias("its_turn"))
    met = F.col("placed_id").eqNullSafe(F.col("its_id")) & (F.col("hashed") == F.col("its_hash")) & (F.col("turn") == F.col("its_turn"))
    return once.union(mine.join(theirs, met).select(*docs.columns, "place.*"))
