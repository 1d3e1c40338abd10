import random

import pytest

from filigree.llm import simhash

SCHEMA = "doc_id long, text string, sid string, keys int"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """The smallest doc_id of each component of pairs with similarity 0.8 or more, by comparing all pairs."""
    sets, at = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    return sorted((min((d for d in ds if d is not None), default=None) for ds in out.values()), key=str)


def corpus():
    rng = random.Random(8)
    rows = [(None, None), (5, ""), (9, "one two"), (8, "One  TWO"), (7, "one two three"), (None, "lone words here only now and then"), (6, "twice the same row"), (6, "twice the same row")]
    for i in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((30, 100, 400)))]
        rows.append((100 + i, " ".join(words)))
        for k in range(6):  # copies on both sides of 0.8
            copy = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
            rows.append((1000 + 10 * i + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile", [simhash.NEAR_TILE, 300])
def test_one_of_each_component_stays(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    kept = simhash.near_copies_dropped(docs, tile=tile)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == survivors(rows)
    assert simhash.near_copies_dropped(docs.limit(0)).count() == 0


def test_stage_drops_planted_copies_of_similarity_0_8(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(94)]  # 90 shingles
        copy = list(words)
        copy[20], copy[60] = "changed", "changed"  # 80 of 100 shingles in common
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        assert 5 * len(grams(rows[-1][1]) & grams(rows[-2][1])) == 4 * len(grams(rows[-1][1]) | grams(rows[-2][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


@pytest.mark.parametrize("parts", [1, 3])
def test_forest_of_one_large_family_joins_what_all_pairs_join(parts):
    """700 sets, most of them on both sides of 0.8 to many others: the same components as by comparing all pairs."""
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(common)[: rng.integers(40, 61)], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(700)]
    fps = np.array([simhash.majority(s) for s in sets]).view(np.uint64)
    tiles = np.arange(len(sets)) % parts

    def roots(pairs):
        label = np.arange(len(sets))
        for a, b in pairs:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())}

    members = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(700) for j in range(i) if (parts == 1 or tiles[i] != tiles[j]) and 5 * len(members[i] & members[j]) >= 4 * len(members[i] | members[j])]
    found = simhash.exact_forest(fps, sets, tiles, (4, 5), 64)
    assert 1 < len(roots(pairs)) < 700
    assert roots(found) == roots(pairs)
    assert len(found) == 700 - len(roots(pairs))
