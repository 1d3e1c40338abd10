"""SimHash near-duplicate detection by tiled exact comparison of 64-bit fingerprints.

Fingerprint: ASCII-lower-cased words between ASCII white space, shingles of `width` words (repeats
count), XXH64 with seed 42 of each; a bit is set if more than half of the hashes have it. Fewer words
than `width`: the whole sequence is one shingle; no word (empty or null text): fingerprint zero, which
links like any other.

Links: two fingerprints within `radius` bits agree in full on at least one of radius + 1 bands of their
bits, so each (band, value) block is compared on its own and no link is lost. Inside a block, tiles
ordered by population count are compared with numpy exclusive-or and bit counts; tile pairs whose
population counts differ by more than the radius are skipped. A block above `tile` fingerprints is cut
by population count and hash into tiles, and each pair of tiles is a task's row of its own. A task
returns a spanning forest of the links of its tiles, never all pairs.

Null doc_id: the row has a fingerprint; it is nobody's smallest doc_id (a component of only such rows
has a null component_id). Repeated rows: one result row for each. Empty table: empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.llm.common import components, dropped, frugal, slices, stored

RADIUS, WIDTH, TILE = 2, 3, 4096
#: Bytes of a text whose words are held at once, and where a text may be cut.
PART, SPACE = 1 << 18, re.compile(rb"[\x20\x09-\x0D]")
#: Near copies by similarity of shingles: words a shingle, similarity as a fraction, bits, keys of a set, minima of a key, shingles of a tile.
NEAR_WIDTH, SHARE, WIDE, BANDS, ROWS, NEAR_TILE = 5, (4, 5), 28, 30, 4, 1 << 18


def word_lists(data: bytes):
    """Lower-cased words of one UTF-8 text, a list for each PART bytes (a longer word stays whole)."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + PART)
        end = space.start() if space else len(data)
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(data: bytes, width: int):
    """XXH64 of the shingles of one UTF-8 text, repeats included; words and shingles are held for one part at a time."""
    import numpy as np
    import xxhash

    digest, found, last = xxhash.xxh64_intdigest, [], []
    for words in word_lists(data):
        words = last + words
        last = words[max(0, len(words) - width + 1) :]
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))
    if found:
        return np.concatenate(found)
    return np.array([digest(b" ".join(last), 42)] if last else [], dtype=np.uint64)


def majority(hashes) -> int:
    """Signed 64-bit SimHash of the hashes; zero if there are none."""
    import numpy as np

    hashes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    return majority(shingle_hashes(data, width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with fp in place of text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t or b"", width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), fps], names=[*kept, "fp"])

    return docs.mapInArrow(frugal(run), T.StructType([*(docs.schema[c] for c in kept), T.StructField("fp", T.LongType())]))


def forest(fps, tiles, radius: int, step: int = 512):
    """Spanning forest of the links of radius bits between fingerprints, as two index arrays.

    tiles: a number for each fingerprint; if there are two different ones only pairs across count.
    """
    import numpy as np

    n = len(fps)
    pops = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    fps, pops, tiles = fps[order], pops[order], tiles[order]
    across = tiles[0] != tiles[-1] or bool((tiles != tiles[0]).any())
    label = np.arange(n)
    left, right = [], []
    for i in range(0, n, step):
        for j in range(i, n, step):
            if pops[j] - pops[min(i + step, n) - 1] > radius:
                break
            near = np.bitwise_count(fps[i : i + step, None] ^ fps[None, j : j + step]) <= radius
            if across:
                near &= tiles[i : i + step, None] != tiles[None, j : j + step]
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            while len(a):
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    break
                # one link for each pair of labels, then each label joins the lowest label it touches
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                first = np.lexsort((low, high))
                first = first[np.unique(high[first], return_index=True)[1]]
                left.append(a[first])
                right.append(b[first])
                to = np.arange(n)
                to[high[first]] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
    if not left:
        return order[:0], order[:0]
    return order[np.concatenate(left)], order[np.concatenate(right)]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all that lie within radius bits."""
    bands, at = radius + 1, 0
    keys = []
    for band in range(bands):
        bits = (64 - at) // (bands - band)
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        keys.append(F.struct(F.lit(band).alias("band"), value.alias("value")))
        at += bits
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("key"))
    rows = rows.select("fp", "pop", "key.band", "key.value")
    blocks = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(blocks, ["band", "value"])
    # The few large blocks: how many tiles each population count takes. At most 65 entries a block.
    large = rows.where(F.col("n") > tile).groupBy("band", "value", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    large = large.groupBy("band", "value").agg(F.map_from_entries(F.collect_list(F.struct("pop", "k"))).alias("k"))
    small = rows.where(F.col("n") <= tile).select("band", "value", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("tile"), "fp")
    code = lambda pop, salt: pop.cast("long") * (1 << 32) + salt.cast("long")
    cut = rows.where(F.col("n") > tile).join(large, ["band", "value"])
    cut = cut.withColumn("tile", code(F.col("pop"), F.pmod(F.xxhash64("fp"), F.col("k")[F.col("pop")])))
    near = F.flatten(F.transform(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda q: F.when(F.col("k")[q].isNotNull(), F.transform(F.sequence(F.lit(0), F.col("k")[q] - 1), lambda s: code(q, s))).otherwise(F.array().cast("array<bigint>"))))
    cut = cut.select("band", "value", "tile", "fp", F.explode(near).alias("other"))
    cut = cut.select("band", "value", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp")
    groups = small.union(cut).groupBy("band", "value", "lo", "hi").agg(F.collect_list("fp").alias("fps"), F.collect_list("tile").alias("tiles"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                fp = np.asarray(batch.column("fps")[k].values)
                tiles = np.asarray(batch.column("tiles")[k].values)
                if len(fp) > 1 and (batch.column("lo")[k].as_py() == batch.column("hi")[k].as_py() or (tiles != tiles[0]).any()):
                    a, b = forest(fp.view(np.uint64), tiles, radius)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return groups.select("lo", "hi", "fps", "tiles").mapInArrow(frugal(run), "a long, b long")


def _named(docs: DataFrame, width: int, radius: int, tile: int) -> DataFrame:
    """docs without text, with fp, root (the component's smallest fingerprint) and component_id."""
    marks = stored(fingerprints(docs, width))
    fps = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, radius, tile)).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written first, so that the join reads two plain shuffles, whose skewed partitions Spark can split: a fingerprint may be very common.
    return marks.join(stored(fps.select("fp", "root").join(first, "root")), "fp")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): a row for each document; component_id is the smallest doc_id reachable over links."""
    return _named(docs.select("doc_id", "text"), width, radius, tile).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then of the smallest text hash.

    Rows that repeat both count as copies too. All columns stay as they are.
    """
    hashed = F.xxhash64("text")
    named = _named(docs.select("doc_id", "text", hashed.alias("hashed")), width, radius, tile)
    keys = named.groupBy("root", "doc_id", "hashed").agg(F.count("*").alias("n"))
    keys = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hashed", "n")).alias("key"))
    return rows_of(docs, keys.select(F.col("key.doc_id").alias("kept_id"), F.col("key.hashed").alias("kept_hash"), F.col("key.n").alias("kept_n")))


def rows_of(docs: DataFrame, keys: DataFrame, *scratch: DataFrame) -> DataFrame:
    """One row of docs for each of keys (kept_id, kept_hash: of its text, kept_n: how many rows have both).

    scratch: stored tables that only keys reads; they go.
    """
    keys = stored(keys)
    for read in scratch:
        dropped(read)
    hashed = F.xxhash64("text")
    same = docs["doc_id"].eqNullSafe(keys["kept_id"]) & hashed.eqNullSafe(keys["kept_hash"])
    once = docs.join(keys.where("kept_n = 1"), same, "left_semi")
    repeated = keys.where("kept_n > 1")
    if repeated.isEmpty():
        return once
    again = docs.join(repeated, same).dropDuplicates(["kept_id", "kept_hash"]).select(*[docs[c] for c in docs.columns])
    return once.union(again)


def minima():
    """A function of a set that is not empty: its BANDS keys, each of ROWS minimum hashes of 32 bits."""
    import numpy as np
    import xxhash

    by = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(hashes) -> list[int]:
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(hashes), 1 << 11):
            least = np.minimum(least, np.multiply.outer(hashes[at : at + (1 << 11)], by).view(np.uint32).min(axis=0))
        parts = least.tobytes()
        return [xxhash.xxh64_intdigest(parts[b * 4 * ROWS : (b + 1) * 4 * ROWS], b) - (1 << 63) for b in range(BANDS)]

    return keys


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs with sid (hash of the set of shingles) and keys in place of text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        keys_of = minima()
        for part in slices(batches, "text"):
            sids, keys = [], []
            for t in part.column("text").cast(pa.binary()).to_pylist():
                found = np.unique(shingle_hashes(t or b"", width))
                sids.append(xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63))
                keys.append(keys_of(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=[*kept, "sid", "keys"])

    return docs.mapInArrow(frugal(run), T.StructType([*(docs.schema[c] for c in kept), T.StructField("sid", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


class Sets:
    """Sorted sets of hashes, with the exact question which of some of them are similar to one of them."""

    def __init__(self, sets: list, share: tuple[int, int]):
        import numpy as np

        self.sets, self.share, self.sizes = sets, share, np.array([len(s) for s in sets])
        self.posted = None

    def postings(self):
        import numpy as np

        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        _, self.term, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        self.posted = owner[np.argsort(self.term, kind="stable")]
        self.upto, self.ends = np.cumsum(times), np.cumsum(self.sizes)
        self.from_ = self.upto - times

    def similar(self, i: int, js):
        """Those of js that are similar to i.

        A similar set holds p / q of the terms of i, so at least one of any a - ceil(p a / q) + 1 of its a terms: only
        the owners of so many of the rarest are counted in full.
        """
        import numpy as np

        p, q = self.share
        size = int(self.sizes[i])
        if size and len(js) >= 8:
            if self.posted is None:
                self.postings()
            own = self.term[self.ends[i] - size : self.ends[i]]
            own = own[np.argsort(self.upto[own] - self.from_[own], kind="stable")]
            few = size + (-p * size // q) + 1
            both = self.counts(own[:few])
            js = js[both[js] > 0]
            if len(js) >= 8:
                both = (both + self.counts(own[few:]))[js]
        if not size or len(js) < 8:
            both = np.array([np.isin(self.sets[i], self.sets[j], assume_unique=True).sum() for j in js], dtype=np.int64)
        return js[(p + q) * both >= p * (size + self.sizes[js])]  # both / (a + b - both) >= p / q

    def counts(self, terms):
        """How many of terms each set holds."""
        import numpy as np

        held = [self.posted[self.from_[t] : self.upto[t]] for t in terms]
        return np.bincount(np.concatenate(held) if held else [], minlength=len(self.sets))


def exact_forest(fps, sets: list, tiles, share: tuple[int, int], wide: int, step: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets whose similarity is at least share[0] / share[1], as pairs of places.

    As forest, tile by tile: exclusive-or and bit counts of the fingerprints fps say which pairs may be similar
    (within wide bits, and of sizes that allow it); of those in different trees the sets are compared in full.
    """
    import numpy as np

    n, (p, q) = len(fps), share
    pops = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    fps, pops, tiles = fps[order], pops[order], tiles[order]
    known = Sets([sets[k] for k in order], share)
    sizes, label, out = known.sizes, np.arange(n), []
    across = bool((tiles != tiles[0]).any())
    rows = max(1, min(step, (1 << 25) // n))
    for i in range(0, n, rows):
        near = np.zeros((min(rows, n - i), n), dtype=bool)
        for j in range(i, n, step):
            if pops[j] - pops[min(i + rows, n) - 1] > wide:
                break
            a, b = sizes[i : i + rows, None], sizes[None, j : j + step]
            near[:, j : j + step] = (np.bitwise_count(fps[i : i + rows, None] ^ fps[None, j : j + step]) <= wide) & (q * np.minimum(a, b) >= p * np.maximum(a, b))
        if across:
            near &= tiles[i : i + rows, None] != tiles[None]
        for one in i + np.flatnonzero(near.any(axis=1)):
            # Once for all later tiles, as the count of common shingles is the costly part.
            js = np.flatnonzero(near[one - i])
            js = js[(js > one) & (label[js] != label[one])]
            for two in known.similar(int(one), js) if len(js) else ():
                if label[two] != label[one]:
                    out.append((int(order[one]), int(order[two])))
                    label[label == label[two]] = label[one]
    return out


def exact_links(sets: DataFrame, share: tuple[int, int], wide: int, tile: int) -> DataFrame:
    """(a, b): links between sets (block, sid, fp, grams) that connect all similar ones of each block.

    A block of more than `tile` shingles is cut by hash; each tile and each pair of tiles is a row of its own.
    """
    sets = sets.withColumn("n", F.size("grams").cast("long"))
    large = stored(sets.groupBy("block").agg(F.ceil(F.sum("n") / tile).cast("int").alias("k")).where("k > 1"))
    rows = sets.join(large, "block", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    groups = rows.groupBy("block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("sid", "fp", "own", "grams")).alias("sets"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column("sets")[k].values
                sids, fps, own, grams = (np.asarray(held.field("sid")), np.asarray(held.field("fp")).view(np.uint64), np.asarray(held.field("own")), held.field("grams"))
                if len(sids) > 1:
                    pairs = exact_forest(fps, [np.asarray(grams[i].values) for i in range(len(sids))], own, share, wide)
                    if pairs:
                        a, b = np.array(pairs).T
                        yield pa.RecordBatch.from_arrays([pa.array(sids[a]), pa.array(sids[b])], names=["a", "b"])

    return groups.select("sets").mapInArrow(frugal(run), "a long, b long")


def candidate_blocks(sets: DataFrame) -> DataFrame:
    """(sid, block) of the sets (sid, keys) that share a key with another one."""
    rows = stored(sets.select("sid", F.explode("keys").alias("key")))
    # Written first, so that the join reads two plain shuffles: a key may be very common.
    groups = stored(rows.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last").select("key", "first"))
    edges = rows.join(groups, "key").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    found = stored(components(edges).select(F.col("node").alias("sid"), F.col("root").alias("block")))
    dropped(rows)
    dropped(groups)
    return found


def near_copies_dropped(docs: DataFrame, width: int = NEAR_WIDTH, share: tuple[int, int] = SHARE, wide: int = WIDE, tile: int = NEAR_TILE) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id, then of the smallest text hash.

    Near copies: the Jaccard similarity of the sets of shingles is share[0] / share[1] or more, counted exactly. The
    fingerprints of similar sets differ in up to some 25 bits, too many for equal bands of bits; blocks are therefore
    made of texts that share one of BANDS keys of minimum hashes, or hang together over such texts. Two sets of
    similarity 0.8 share no key with probability (1 - 0.8 ** 4) ** 30, about 1.4e-7, more similar ones with less. In
    a block, tiles of fingerprints of the sets are compared by exclusive-or and bit counts: at similarity 0.8 they
    differ in 10 bits on average (12 in the shortest texts) with a deviation of 3, so more than `wide` with
    probability about 1e-7. What passes is compared in full.

    Null or empty text: an empty set; empty sets are copies of each other. All columns stay as they are.
    """
    hashed = F.xxhash64("text")
    marks = stored(shingle_sets(docs.select("doc_id", "text", hashed.alias("hashed")), width))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hashed")
    sets = stored(marks.groupBy("sid").agg(F.min(place).alias("place"), F.first("keys").alias("keys")))
    blocks = candidate_blocks(sets)
    found = stored(sets.select("sid", "place").join(blocks, "sid").select("sid", "block", F.col("place.doc_id").alias("set_id"), F.col("place.hashed").alias("set_hash")))
    texts = docs.select("doc_id", "text").join(found, hashed.eqNullSafe(F.col("set_hash")) & F.col("doc_id").eqNullSafe(F.col("set_id"))).select("block", "sid", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, width)) for t in part.column("text").cast(pa.binary()).to_pylist()]
            fps = [majority(x) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("sid"), pa.array(fps, pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["block", "sid", "fp", "grams"])

    grams = stored(texts.mapInArrow(frugal(run), "block long, sid long, fp long, grams array<long>"))
    roots = components(exact_links(grams, share, wide, tile)).withColumnRenamed("node", "sid")
    first = sets.select("sid", "place").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    first = first.groupBy("root").agg(F.min("place").alias("place")).select("place")
    keys = marks.groupBy(place.alias("place")).agg(F.count("*").alias("n")).join(first, "place", "left_semi")
    return rows_of(docs, keys.select(F.col("place.doc_id").alias("kept_id"), F.col("place.hashed").alias("kept_hash"), F.col("n").alias("kept_n")), marks, sets, blocks, found, grams)
