"""The queries work on whole tables: results by brute force on small tables of their own."""

import pytest

from filigree.queries import QUERIES


def test_all_vectors_of_a_label_are_relevant(spark, tmp_path):
    # 60 vectors of label 0, in places where only the last of them are near vector 60.
    rows = [(i, [1.0, i / 100.0], 0) for i in range(61)] + [(61 + i, [-1.0, 0.0], 1) for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.qid: r.ndcg for r in QUERIES["ndcg_per_query"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 20: 1.0, 40: 1.0, 60: 1.0}  # the five best of each have its label
    r = QUERIES["retrieval_metrics"](spark, str(tmp_path)).first()
    assert r.precision_5 == 1.0 and r.hit_1 == 1.0 and r.mrr == 1.0
    assert r.recall_5 == pytest.approx(5 / 61, abs=1e-6)
    assert {r.tag: r.hit for r in QUERIES["metrics_by_tag"](spark, str(tmp_path)).collect()} == {"label0": 1.0, "even": 1.0, "odd": 1.0}


def test_every_passage_has_its_ranks(spark, tmp_path):
    docs = [(i, f"alpha {'beta ' * (i % 4)}w{i}" if i % 3 else f"nothing w{i}", "src1", "en") for i in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "w7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["rank_lists"](spark, str(tmp_path)).collect()
    for q in (1, 2):
        own = [r for r in rows if r.qid == q]
        for rank in ("bm25_rank", "tfidf_rank"):
            assert sorted(r[rank] for r in own) == list(range(50))
    rest = sorted((r for r in rows if r.qid == 2 and r.ord != 7), key=lambda r: r.bm25_rank)
    assert [r.ord for r in rest] == [i for i in range(50) if i != 7]  # ties in the order of ord


def test_whole_items_and_turns_are_searched(spark, tmp_path):
    lead = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, "lonely word"), (2, "zebra"), (3, "other")], "doc_id long, text string").selectExpr("doc_id", "text", "'src1' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{lead} zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.qid, r.ord) for r in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()] == [(1, 2)]
    spark.createDataFrame([(1, 0, "bot", "x " * 150 + "in Peru today")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([("Peru",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert [r.scope for r in QUERIES["ticker_resolve"](spark, str(tmp_path)).collect()] == ["PERU"]
