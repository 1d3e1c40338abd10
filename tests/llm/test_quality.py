import random

from pyspark.sql import functions as F

from filigree.llm import linear, quality

WORDS = ["water", "the", "river", "tells", "of", "stone", "light", "and"]


def corpus(spark, n=240):
    rng = random.Random(5)
    docs, labels = [(None, "the river", None), (9000, None, None), (9001, "", None)], [(9000, 1), (None, 0)]
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        good = i % 4 > 0
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), 0.5))
        labels += [(i, int(good))] * (1 + i % 2)
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = corpus(spark)
    model = quality.fitted(docs, labels)
    scored = quality.quality(docs, model)
    assert scored.columns == [*docs.columns, "filigree_score"] and scored.count() == docs.count()
    assert scored.where("filigree_score is null or filigree_score < 0 or filigree_score > 1").count() == 0
    held = scored.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & (F.col("doc_id") < 9000))
    right = held.where((F.col("filigree_score") >= 0.7) == (F.col("doc_id") % 4 > 0)).count()
    assert right >= 0.95 * held.count() > 20


def test_kept_drops_the_rejected(spark):
    docs, labels = corpus(spark)
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("text like '%!!%'").count() <= 3
    assert quality.kept(docs, labels.limit(0)).count() == docs.count()
    assert quality.kept(docs.limit(0), labels).count() == 0


def test_features_are_of_unit_length():
    places = linear.featurizer()
    at, x = places("The cat, the CAT 99!!")
    assert len(set(at.tolist())) == len(at) and abs((x[1:] ** 2).sum() - 1) < 1e-9
    assert places(None)[0].tolist() == [0] == places(" \n ")[0].tolist()
    assert linear.shape("Thnd***99x") == "Aa*9a"
