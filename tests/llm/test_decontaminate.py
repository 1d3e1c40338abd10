import random
import re
from collections import Counter

from filigree.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").encode().lower())
        if item is not None and words:
            for k in range(max(1, len(words) - size + 1)):
                windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall((text or "").encode().lower()), set(), set()
        for window, names in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= names
        out.append((doc_id, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def windows_of(items, size=13):
    for item, text in items:
        words = WORD.findall((text or "").encode().lower())
        if item is not None and words:
            yield from {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def brute_near(docs, items, size=13, slack=2):
    """Items near each document, window by window and place by place."""
    split = lambda t: WORD.findall((t or "").encode().lower())
    texts = [split(t) for _, t in docs]
    counts = Counter(w for words in texts for w in words)
    out = []
    for (doc_id, _), words in zip(docs, texts, strict=True):
        found = set()
        for item, text in items:
            own = split(text) if item is not None else []
            for s in range(max(1, len(own) - size + 1) if own else 0):
                window = own[s : s + size]
                order = sorted(range(len(window)), key=lambda j: (counts[window[j]], window[j], j))
                a, b = order[0], order[min(1, len(order) - 1)]
                for p in (p for p, w in enumerate(words) if w == window[a]):
                    near = [window[j] in words[max(0, p - a + j - slack) : max(0, p - a + j + slack + 1)] for j in range(len(window))]
                    if near[b] and sum(near) >= len(window) - len(window) // 6:
                        found.add(str(item))
        out.append((doc_id, sorted(found)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = ["a", "B", "çé", "d4", "e", "the", "the", "the"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(None, "a b"), (50, None), (51, " .. "), (52, "unseen words only"), (3, "second text of item three, the a the e d4 e a the the the the B a")]
    docs = [(None, None), (900, ""), (901, "-- !")]
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if i % 2 and items[i % 12][1]:
            body[5:5] = items[i % 12][1].upper().split() if i % 4 == 1 else items[i % 12][1].split()
        docs += [(i, ", ".join(body))] * (1 + (i == 7))
    return docs, items


def test_equals_brute_force_and_stage_keeps_the_rest(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, k1 string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    rows = lambda: sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(d, b).collect()), key=str)
    assert rows() == want
    kept = decontaminate.clean(d, b)
    whole = {t for i, t in docs if any(len(w) == 13 and any(tuple(words[k : k + 13]) == w for k in range(len(words))) for words in [WORD.findall((t or "").encode().lower())] for w in windows_of(items))}
    assert kept.columns == d.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for (i, t), w in zip(sorted(docs, key=lambda x: str(x[0])), sorted(want, key=lambda w: str(w[0])), strict=True) if not w[4] and t not in whole)
    monkeypatch.setattr(decontaminate, "BLOCK", 300)  # several passes
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    assert rows() == want


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    none = decontaminate.contamination(d, b.limit(0))
    assert none.count() == len(docs) and none.where("contaminated or n_hit > 0").count() == 0


def test_proximity_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    rng = random.Random(5)
    passage = [f"term{k}" for k in range(20)]
    items = [*items, (77, " ".join(passage))]
    for i in range(20):
        near = list(passage)
        for k in range(i % 5):
            near.insert(rng.randrange(len(near)), "put") if k % 2 else near.pop(rng.randrange(len(near)))
        docs.append((1000 + i, " ".join(["before"] * i + near)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(((r.doc_id, list(r.near)) for r in decontaminate.contamination(d, b).collect()), key=str)
    want = brute_near(docs, items)
    assert rows() == want and sum("77" in w[1] for w in want) > 10
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert rows() == want


def test_a_passage_in_a_very_long_document_goes(spark):
    passage = " ".join(f"term{k}" for k in range(13))
    long = " ".join(f"w{k % 700}" for k in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long), (3, passage.rsplit(" ", 1)[0])], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, b).orderBy("doc_id").collect()] == [2, 3]
    assert not decontaminate.contamination(docs, b).where("contaminated").count()
