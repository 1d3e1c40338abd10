import random

from filigree.llm import lines, sharding


def corpus(n=300):
    rng = random.Random(4)
    texts = [None, "", "huge group"] + [f"text {i} é" for i in range(120)]
    return [(i, texts[2] if i % 3 == 0 else rng.choice(texts)) for i in range(n)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]


def test_rows_law_slots_and_cut_groups(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(docs, shards=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    text = dict(rows[:300])
    shards = {}
    for r in got:
        if r.doc_id is not None and r.doc_id in text and r.doc_id != 5:
            shards.setdefault(text[r.doc_id], set()).add(r.shard)
            assert r.size == len((text[r.doc_id] or "").encode()) + 16
    again = sharding.sharded(docs.repartition(3), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_groups_gather_where_there_is_room(spark):
    rows = [(i, "huge group" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 and i < 300 else f"single {i}") for i in range(900)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    shards = {}
    for r in found:
        shards.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    pairs = [len(s) for t, s in shards.items() if t.startswith("pair")]
    assert sum(pairs) <= 1.2 * len(pairs) and len(shards["huge group"]) <= 6


def test_no_shard_is_lifted_beyond_its_quota(spark):
    rng = random.Random(6)
    linked = [(h, s, rng.randrange(1, 9)) for h in range(60) for s in range(5) if rng.random() < 0.7]
    quota = [sum(n for _, _, n in linked) // 5 + 10] * 5
    first = [sum(n for _, s, n in linked if s == k) for k in range(5)]
    found = sharding.propagated(spark.createDataFrame(linked, "hub long, first int, n long"), quota).collect()
    last = [sum(r.n for r in found if r.shard == k) for k in range(5)]
    assert sum(last) == sum(first) and all(now <= max(q, was) for now, q, was in zip(last, quota, first, strict=True)), (first, last)
    assert len({(r.hub, r.shard) for r in found}) < 0.7 * len(linked)


def test_documents_come_with_their_places(spark):
    rows = [(i, t, f"en{i}", 1) for i, t in corpus()] + [(None, None, "de", 2), (5, "again", "es", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int")
    got = sharding.laid_out(docs, shards=7)
    assert got.columns == ["doc_id", "text", "lang", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.lang) for r in got))) == sorted(str(r[:3]) for r in rows)
    places = lambda rs: sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in rs)
    assert places(got) == places(sharding.sharded(docs, shards=7).collect())
    assert sharding.laid_out(docs.limit(0), shards=7).count() == 0


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = sharding.sharded(docs).collect()
    assert sorted(r.shard for r in got) == [0, 1, 2] and {r.slot for r in got} == {0}
    assert sharding.sharded(docs.limit(0)).count() == 0


def brute(rows, words=20):
    """Runs of every length."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        own, gone = t.split("\n"), set()
        n = [len(x.split()) for x in own]
        for p in range(len(own)):
            for z in range(1, len(own) - p + 1):
                if sum(n[p : p + z]) >= words:
                    if tuple(own[p : p + z]) in seen:
                        gone.update(range(p, p + z))
                    seen.add(tuple(own[p : p + z]))
        out[i] = ("\n".join(x for j, x in enumerate(own) if j not in gone), len(own), len(gone))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice((0, 1, 3, 5, 30)))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, "\n".join(["a b c d e"] * 20)), (102, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, None, "y")], "doc_id long, text string, pos string")
    got = lines.deduplicated(docs)
    assert got.columns == [*docs.columns, "filigree_lines", "filigree_removed"]
    found = {r.doc_id: (r.text, r.filigree_lines, r.filigree_removed) for r in got.collect()}
    assert found.pop(None) == (None, 0, 0)
    assert found == brute(rows)
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_runs_of_every_length_go_whole(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    runs = [[line(n) for _ in range(k)] for n, k in ((4, 5), (3, 7), (2, 11), (60, 1))]
    runs[3] += [line(1) for _ in range(6)]  # the last of them has to go too
    runs.append([line(1) if i % 4 == 0 else f"{' ' * i}" for i in range(100)])  # 25 words in 100 lines
    runs.append([line(19)])  # too short
    rows = [(2 * i + k, "\n".join([line(3), *run, line(3)])) for i, run in enumerate(runs) for k in (0, 1)]
    pool = [line(rng.choice((0, 1, 2, 4, 9))) for _ in range(6)]
    rows += [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    found = {r.doc_id: (r.text, r.filigree_lines, r.filigree_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)
    assert [found[i][2] for i in range(0, 12)] == [0, 5, 0, 7, 0, 11, 0, 7, 0, 100, 0, 0]
