import random

from pyspark.sql import functions as F

from filigree.llm import language, mixing, toxicity
from filigree.llm.common import WordIds

HELD = "crc32(cast(doc_id as string)) % 4 = 2"


def test_language_held_out(spark):
    rng = random.Random(8)
    parts = {"en": "the ing tion er of and".split(), "de": "der ung sch ein ü ge".split(), "fr": "eau le é que ment".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang, 1.0) for i in range(240) for lang in [list(parts)[i % 3]]]
    rows += [(1000, None, "en", 1.0), (1001, "12 .. 3", "de", 1.0), (None, "der der", None, 1.0), (1002, "", None, 1.0), (1003, "½² ① ٣", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fitted(docs, ~F.expr(HELD))
    got = language.identified(docs, model)
    assert got.count() == len(rows) and got.where("filigree_lang.score < 0 or filigree_lang.score > 1").count() == 0
    assert {r.doc_id for r in got.where("filigree_lang.lang = 'und'").collect()} == {1000, 1001, 1002, 1003}
    assert got.where(F.expr(HELD) & (F.col("doc_id") < 1000) & (F.col("filigree_lang.lang") != F.col("lang"))).count() == 0
    none = language.identified(docs, language.fitted(docs.limit(0)))
    assert none.where("filigree_lang.lang != 'und'").count() == 0
    assert language.identified(docs.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    import numpy as np

    levels = language.model_of(["abab abba baab", "aabb"], order=3)
    signs = [np.uint64(ord(c) + 1) for c in "ab "]
    for head in ("ab", "ba", " a"):
        total = 0.0
        for c in signs:
            codes = np.array([np.uint64(ord(head[0]) + 1), np.uint64(ord(head[1]) + 1), c], np.uint64)
            keys = [(None, language.gram_keys(codes[2:], 1))] + [(language.gram_keys(codes[3 - n : 2], n - 1), language.gram_keys(codes[3 - n :], n)) for n in (2, 3)]
            total += float(np.exp(language.log_probability(levels, keys))[0])
        unseen = np.array([np.uint64(ord(head[0]) + 1), np.uint64(ord(head[1]) + 1), np.uint64(9999)], np.uint64)
        keys = [(None, language.gram_keys(unseen[2:], 1))] + [(language.gram_keys(unseen[3 - n : 2], n - 1), language.gram_keys(unseen[3 - n :], n)) for n in (2, 3)]
        assert abs(total + float(np.exp(language.log_probability(levels, keys))[0]) - 1) < 1e-6


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(9)
    lexicon = {"idiot": False, "moron": False, "worthless": False, "scum": False, "lost": True, "pathetic": False, "disgusting": True}
    matcher = toxicity.Matcher(lexicon)
    for _ in range(3000):
        w = list(rng.choice(list(lexicon)))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = [rng.choice("aeiost")] * rng.randrange(2)
        w = "".join(w)
        want = []
        for t, stem in lexicon.items():
            heads = [w[:n] for n in range(1, len(w) + 1)] if stem else [w]
            d = min((edits(t, h) for h in heads), default=99)
            if d <= toxicity.allowed(t):
                want.append((d, t))
        assert matcher.match(w) == min(want, default=None), w


def test_toxic_misspelled_quoted_and_clean():
    rng = random.Random(10)
    fill = lambda n: [rng.choice("water stone river light under over table green".split()) + str(rng.randrange(300)) for _ in range(n)]
    rows = []
    for i in range(300):
        words = fill(40)
        if i % 5 == 0:
            for w in rng.sample(["idiot", "moron", "worthless", "vequ" + rng.choice("abcde") * 2 + str(i)], 2):
                words.insert(rng.randrange(40), w)
        rows.append((" ".join(words), int(i % 5 == 0)))
    model = toxicity.learned(rows)
    found = model.finder()
    z = lambda t: sum(a * b for a, b in zip(model.weights, model.features(t, found), strict=True))
    assert {"idiot", "moron", "worthless"} <= set(model.lexicon)
    assert z("you are an idiot and a moron") > 0 > z(" ".join(fill(200)))
    assert z("you are an id1ot , such a worthles thing") > 0
    assert z("you idiot") > z('he said "you idiot" there')
    assert z(None) == z("") < 0
    assert isinstance(found, WordIds)


def test_mixture_meets_targets_and_keeps_clean(spark):
    rng = random.Random(11)
    rows, labels = [(None, None, 1), (9000, "", 1)], []
    for i in range(400):
        kind = (0, 0, 0, 1, 2)[i % 5]
        words = [rng.choice("water stone river light".split()) for _ in range(30)]
        words = words if kind == 0 else [*words, "idiot", "moron"] if kind == 1 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), kind))
        labels.append((i, int(kind != 2), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixture(docs, marks, ceiling=1.0).toPandas()
    assert len(got) == len(rows) and got.rate.between(0, 1).all()
    # The fit against a long plain projected gradient on the same posteriors: totals as close to the targets.
    import numpy as np

    a = (got[[f"p_{d}" for d in mixing.DOMAINS]].values * got.tokens.values[:, None]).T
    share = np.array(mixing.TARGETS) / sum(mixing.TARGETS)
    goal = np.minimum(share * a[0].sum() / share[0], a.sum(axis=1))
    r = np.ones(len(got))
    for _ in range(20000):
        r = np.clip(r - a.T @ (a @ r - goal) / (np.linalg.norm(a, 2) ** 2), 0, 1)
    assert np.linalg.norm(a @ got.rate.values - goal) <= np.linalg.norm(a @ r - goal) + 0.01 * goal.sum()
    kept = mixing.mixed(docs, marks)
    assert kept.columns == docs.columns
    assert kept.where("rate = 0").count() >= 0.97 * 240
    assert mixing.mixed(docs.limit(0), marks).count() == 0
    assert mixing.mixed(docs, marks.limit(0)).count() > 0


def test_a_scarce_domain_reaches_its_share(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        kind = 1 if i % 50 == 0 else 2 if i % 4 == 1 else 0  # toxic: 2 of 100, wanted: 5 of 100
        p = [0.02, 0.02, 0.02]
        p[kind] = 0.96 - 0.1 * rng.random()
        rows.append((i, ([x / sum(p) for x in p], rng.randrange(0, 60))))
    scored = spark.createDataFrame(rows, f"doc_id long, {mixing.MARK} struct<p:array<double>,tokens:bigint>")
    wanted = [0.75, 0.05, 0.2]
    fit = mixing.fitted(scored, wanted, strict=True)
    total = sum(m[1] for _, m in rows)
    assert max(abs(x / total - w) for x, w in zip(fit.reached, wanted, strict=True)) < 1e-3
    r = mixing.rate(F.col(mixing.MARK)["p"], fit.moves, fit.ceiling)
    got = scored.select("doc_id", r.alias("rate"), mixing.copies("doc_id", r).alias("copies")).toPandas()
    assert 1 < got.rate.max() <= mixing.MOST and got.rate.min() >= 0 and abs(got.copies - got.rate).max() < 1
    for out in ([0.0, 1.0, 0.0], [0.0, 0.0, 0.0]):  # cannot be reached with so few; nothing wanted
        assert len(mixing.fitted(scored, [x + 1e-9 for x in out]).reached) == 3
