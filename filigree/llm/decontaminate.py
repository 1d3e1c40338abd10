"""Benchmark decontamination with a distributed positional inverted index.

Words: ASCII letters lower-cased, then runs of ASCII letters and digits and of all signs beyond ASCII. A
window is `size` consecutive words of an item (an item of fewer words is one window).

The index is dealt by documents: a segment of some megabytes of text holds, for each of its words, the list of
positions in the segment's stream of words (differences, 32 bits each), and the documents' ids and lengths. It is
written to the shared folder without a shuffle, holds every word of every text, and serves any benchmark.

Search: counts of the benchmark's words over all segments tell the rarest and second rarest word of each window. In
a segment the list of the rarest word, less its offset in the item, is intersected with the list of the second,
then with those of all words of the item. An exact match is a window all of whose words lie on one diagonal. A
window is near where its rarest word occurs, the second lies within `slack` words of its place, and all of its n
words but n // 6 do. Lists are intersected by position: they are laid out over the segment's stream once, so each
further list costs one look at the place where its word should be.

Items are taken in blocks of BLOCK characters, each small enough to send to every task; a larger benchmark takes
more passes over the index, not over the texts. Null and empty text: no words, no hit. A very long text is a segment
of its own. Repeated rows are rows of their own; ties of rarity go to the smaller word, then the smaller offset.
Items without item_id are left out; items without words match nothing; several texts of one item_id count as that
item. Empty tables: no rows, or no hits. Extra columns: ignored, or kept by clean().
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import dropped, frugal, slices, stored

SIZE, SLACK, BLOCK = 13, 2, 4_000_000
#: Contract: a document is contaminated if at least a twentieth of its words are hit.
SHARE = 20
#: So many postings are looked at together.
CHUNK = 1 << 20


def splitter():
    import re

    found = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    return lambda text: found(text.lower())


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def index(docs: DataFrame) -> DataFrame:
    """A row for each segment: its documents (ids, text hashes, words) and the postings of all its words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        split, number = splitter(), TaskContext.get().partitionId() << 32
        for part in slices(batches, "text"):
            known: dict[bytes, int] = {}
            n_words, ids = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = split(text) if text else []
                n_words.append(len(words))
                ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            ids = np.concatenate(ids)
            lens = np.bincount(ids, minlength=len(known)).astype(np.int32)
            at = np.argsort(ids, kind="stable").astype(np.int32)
            steps = np.diff(at, prepend=np.int32(0))
            firsts = np.cumsum(lens) - lens
            steps[firsts] = at[firsts]
            one = lambda a, t: pa.array([a], pa.list_(t))
            columns = [pa.array([number]), *(pa.ListArray.from_arrays([0, part.num_rows], part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c)) for c in ("doc_id", "k1", "k2"))]
            columns += [one(n_words, pa.int32()), pa.array([b" ".join(known)]), pa.array([lens.tobytes()]), pa.array([steps.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "doc_ids", "k1", "k2", "n_words", "terms", "lens", "steps"])
            number += 1

    return stored(keys.mapInArrow(frugal(run), f"segment long, doc_ids array<{kind}>, k1 array<long>, k2 array<long>, n_words array<int>, terms binary, lens binary, steps binary"))


def term_counts(found: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of the terms occurs in all documents."""
    held = found.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        known, total = held.value, Counter()
        for batch in batches:
            for words, lens in zip(batch.column("terms"), batch.column("lens"), strict=True):
                for word, n in zip(words.as_py().split(b" "), np.frombuffer(lens.as_py(), np.int32), strict=False):
                    if word in known:
                        total[word] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    got = found.select("terms", "lens").mapInArrow(frugal(run), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in got.collect()}  # at most the terms of one block


def plan(items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], size: int) -> dict:
    """What every task needs of a block: words as numbers, and the windows (item, start) by their two rarest places."""
    numbers: dict[bytes, int] = {}
    pairs: dict[tuple[int, int, int], list[int]] = {}
    for i, (_, words) in enumerate(items):
        order = sorted(range(len(words)), key=lambda j: (counts.get(words[j], 0), words[j], j))
        rank = [0] * len(words)
        for r, j in enumerate(order):
            rank[j] = r
        for w in words:
            numbers.setdefault(w, len(numbers))
        for s in range(max(1, len(words) - size + 1)):
            places = sorted(range(s, min(s + size, len(words))), key=rank.__getitem__)
            pairs.setdefault((i, places[0], places[min(1, len(places) - 1)]), []).append(s)
    return {"names": [i for i, _ in items], "numbers": numbers, "words": [[numbers[w] for w in ws] for _, ws in items], "pairs": list(pairs.items()), "size": size}


def ragged(counts):
    """(owner, place within the owner) of sum(counts) cells."""
    import numpy as np

    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Search:
    """A block of items against one segment after another."""

    def __init__(self, block: dict, slack: int):
        import numpy as np

        self.names, self.numbers, self.size, self.slack = np.array(block["names"], dtype=object), block["numbers"], block["size"], slack
        self.m = np.array([len(w) for w in block["words"]])
        self.base = np.cumsum(self.m) - self.m
        self.words = np.concatenate([np.array(w, np.int32) for w in block["words"]])
        self.n = np.minimum(self.m, self.size)
        keys = np.array([k for k, _ in block["pairs"]], np.int64)
        self.item, self.a, self.b = keys.T
        starts = [s for _, s in block["pairs"]]
        self.k = np.array([len(s) for s in starts])
        self.first = np.cumsum(self.k) - self.k
        self.starts = np.concatenate([np.array(s, np.int64) for s in starts])

    def segment(self, terms: bytes, lens, steps, n_words):
        """(document, item, place) of each exact window and (document, item) of each near one."""
        import numpy as np

        total, ends = int(n_words.sum()), np.cumsum(n_words)
        upto = np.cumsum(lens)
        own = np.fromiter((self.numbers.get(w, -1) for w in terms.split(b" ")), np.int32, len(lens)) if len(lens) else np.empty(0, np.int32)
        at = np.cumsum(steps, dtype=np.int64)
        firsts = upto - lens
        at -= np.repeat(np.where(firsts > 0, at[firsts - 1], 0) if len(lens) else firsts, lens)
        stream = np.full(total, -1, np.int32)
        stream[at] = np.repeat(own, lens)
        where = np.full(len(self.numbers), -1)
        where[own[own >= 0]] = np.flatnonzero(own >= 0)
        column = where[self.words[self.base[self.item] + self.a]]
        live = np.flatnonzero(column >= 0)
        exact, near = [], []
        sizes = lens[column[live]].astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=0))
        for group in np.split(np.arange(len(live)), cut):
            if not len(group):
                continue
            owner, step = ragged(sizes[group])
            pair = live[group][owner]
            p = at[firsts[column[pair]] + step]
            for lo in range(0, len(p), CHUNK):  # one list may be longer than a chunk
                self.matches(pair[lo : lo + CHUNK], p[lo : lo + CHUNK], stream, ends, n_words, exact, near)
        cat = lambda rows, k: [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * k
        return cat(exact, 3), cat(near, 2)

    def matches(self, pair, p, stream, ends, n_words, exact, near):
        import numpy as np

        item, total = self.item[pair], len(stream)
        second = self.words[self.base[item] + self.b[pair]]
        q = p - self.a[pair] + self.b[pair]
        met = np.zeros(len(p), bool)
        for e in range(-self.slack, self.slack + 1):
            met |= stream[np.clip(q + e, 0, total - 1)] == second  # what the clip lets in is caught below
        pair, p, item = pair[met], p[met], item[met]
        if not len(p):
            return
        doc = np.searchsorted(ends, p, side="right")
        lo, hi, d = ends[doc] - n_words[doc], ends[doc], p - self.a[pair]
        owner, j = ragged(self.m[item])
        word = self.words[self.base[item][owner] + j]
        q = d[owner] + j
        there = lambda q: (q >= lo[owner]) & (q < hi[owner]) & (stream[np.clip(q, 0, total - 1)] == word)
        on = there(q)
        around = on.copy()
        for e in range(1, self.slack + 1):
            around |= there(q + e) | there(q - e)
        cells = np.cumsum(self.m[item]) - self.m[item]
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        on, around_sum = sums(on), sums(around)
        who, k = ragged(self.k[pair])  # each window of the pair
        s = self.starts[self.first[pair][who] + k]
        at, n = cells[who] + s, self.n[item][who]
        hit = on[at + n] - on[at] == n
        exact.append((doc[who][hit], item[who][hit], (d[who] + s)[hit]))
        close = (around_sum[at + n] - around_sum[at] >= n - n // 6) & around[cells[who] + self.b[pair][who]]
        near.append((doc[who][close], item[who][close]))


def searched(found: DataFrame, block: dict, slack: int) -> DataFrame:
    """(segment, ord, items, near, ranges, whole) of each document with a match; ranges: runs of hit words, whole: one of a window of full size."""
    held = found.sparkSession.sparkContext.broadcast(pickle.dumps(block))  # one block of items

    def run(batches):
        import numpy as np
        import pyarrow as pa

        block = pickle.loads(held.value)
        search = Search(block, slack)
        for batch in batches:
            rows = []
            for segment, terms, lens, steps, n_words in zip(*(batch.column(c) for c in ("segment", "terms", "lens", "steps", "n_words")), strict=True):
                n_words = np.asarray(n_words.values)
                (doc, item, p), (near_doc, near_item) = search.segment(terms.as_py(), np.frombuffer(lens.as_py(), np.int32), np.frombuffer(steps.as_py(), np.int32), n_words)
                starts = np.cumsum(n_words) - n_words
                for k in np.unique(near_doc):  # an exact window is a near one, too
                    own = doc == k
                    mine = item[own]
                    first, size = p[own] - starts[k], search.n[mine]
                    marks = np.zeros(int(n_words[k]) + 1, np.int32)
                    np.add.at(marks, first, 1)
                    np.add.at(marks, first + size, -1)
                    edges = np.flatnonzero(np.diff(np.cumsum(marks) > 0, prepend=False))
                    names = lambda x: sorted(set(search.names[np.unique(x)]))
                    rows.append((segment.as_py(), int(k), names(mine), names(near_item[near_doc == k]), [{"s": int(s), "e": int(e)} for s, e in edges.reshape(-1, 2)], bool((size == search.size).any())))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            text = pa.list_(pa.string())
            kinds = (pa.int64(), pa.int32(), text, text, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["segment", "ord", "items", "near", "ranges", "whole"])

    return found.select("segment", "terms", "lens", "steps", "n_words").mapInArrow(frugal(run), "segment long, ord int, items array<string>, near array<string>, ranges array<struct<s:int,e:int>>, whole boolean")


def found_in(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, items, near, whole) of each document; k1, k2: hashes of its text.

    Its attribute _reads has the stored tables that it reads: who has stored what they need of it may drop them.
    """
    found, parts = index(docs), []
    for items in item_blocks(benchmark):
        split = splitter()
        items = [(r["item_id"], w) for r in items.orderBy("item_id", "text").collect() if (w := split(r["text"].encode()))]
        if items:
            counts = term_counts(found, {w for _, ws in items for w in ws})
            parts.append(stored(searched(found, plan(items, counts, size), slack)))
    each = F.posexplode(F.arrays_zip("doc_ids", "k1", "k2", "n_words")).alias("ord", "d")
    base = found.select("segment", each).select("segment", "ord", F.col("d.doc_ids").alias("doc_id"), "d.k1", "d.k2", F.col("d.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if not parts:
        out = base.select("doc_id", "k1", "k2", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near"), F.lit(False).alias("whole"))
        out._reads = [found]
        return out
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    one = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    places = F.transform(F.flatten(F.collect_list("ranges")), lambda r: F.sequence(r["s"], r["e"] - 1))
    hits = hits.groupBy("segment", "ord").agg(one("items").alias("items"), one("near").alias("near"), F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"), F.max("whole").alias("whole"))
    out = base.join(hits, ["segment", "ord"], "left")
    out = out.select("doc_id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"), F.coalesce("whole", F.lit(False)).alias("whole"))
    out._reads = [found, *parts]
    return out


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near, contaminated) for each document; near: items with exact or proximity matches."""
    return found_in(docs, benchmark, size, slack).select("doc_id", "n_words", "n_hit", "items", "near", contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without those that hold a whole window of `size` words of an item, however long they are, and without those a twentieth of whose words are hit by shorter items; columns stay as they are."""
    found = found_in(docs, benchmark, size)
    bad = found.where(F.col("whole") | contaminated())
    bad = stored(bad.select(F.col("k1").alias("filigree_k1"), F.col("k2").alias("filigree_k2")).distinct())
    for read in found._reads:
        dropped(read)
    same = (F.xxhash64("text") == F.col("filigree_k1")) & (F.xxhash64(F.lit(7), F.col("text")) == F.col("filigree_k2"))
    return docs.join(bad, same, "left_anti")
