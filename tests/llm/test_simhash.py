import random

import pytest
import xxhash

from filigree.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root int"


def slow_fp(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fp(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                at[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids) if ids else None))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gäm", "d", "ÉE", "zeta", "eta", "x"]
    rows = [(None, None), (5, ""), (4, None), (9, "one"), (9, "one"), (8, "One  TWO"), (7, "one two"), (None, "lone words here only")]
    for i in range(60):
        text = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(3, 300)))
        rows.append((100 + i, text))
        for k in range(i % 3):
            parts = text.split()
            parts[rng.randrange(len(parts))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(parts)))
    return rows


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_equal_brute_force(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = [(r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs, tile=tile).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(slow_components(rows), key=key)


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    want = {}
    for (i, t), (_, fp, c) in zip(rows, slow_components(rows), strict=True):
        want.setdefault(c if c is not None else f"none{fp}", []).append(i)
    found = [r.doc_id for r in kept.collect()]
    assert len(found) == len(want)
    assert {i for i in found if i is not None} == {c for c in want if not isinstance(c, str)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicated(docs).count() == 0


def test_forest_links_all_that_are_near():
    import numpy as np

    base = np.uint64(0x0F0F00FF00FF3333)
    fps = np.array([base, base ^ np.uint64(1), base ^ np.uint64(7), base ^ np.uint64(0xFFFF)], np.uint64)
    a, b = simhash.forest(fps, np.zeros(4, np.int64), 2)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset((0, 1)), frozenset((1, 2))}


def test_long_texts_are_shingled_part_by_part():
    """Cut between words only, shingles across cuts included, and memory that is not many times that of the text."""
    import tracemalloc

    rng = random.Random(4)
    size = getattr(simhash, "PART", 1 << 18)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    long = "".join(f"Wörd{rng.randrange(9000)}" + rng.choice(spaces) for _ in range(3 * size // 8))
    for text in (long, " " * (2 * size) + "a b", "x" * (size + 5) + " y " + "z" * size, "a" + " " * (2 * size) + "b", " " * (2 * size), ""):
        for width in (1, 3, 5):
            words = text.encode().lower().split()
            grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
            assert simhash.shingle_hashes(text.encode(), width).tolist() == [xxhash.xxh64_intdigest(g, 42) for g in grams]
    data = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200_000)) + " ").encode() * 4
    tracemalloc.start()
    try:
        simhash.shingle_hashes(data, 5)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(data)
    finally:
        tracemalloc.stop()
