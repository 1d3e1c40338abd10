import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from filigree.llm import quality  # noqa: E402
from filigree.llm.common import stored, table  # noqa: E402
from tests.llm.test_decontaminate import WORD, windows_of  # noqa: E402
from tests.llm.test_near_copies import survivors  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "shard":
            assert docs.columns == before.columns
        if name == "quality":
            model = quality.fitted(before, table(spark, SF, "labels"))
            assert docs.count() == quality.quality(before, model).where("filigree_score >= 0.7").count()
        if name == "simhash":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted((r.doc_id for r in docs.collect()), key=str) == survivors(rows)
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            windows = set(windows_of(items))
            split = lambda t: WORD.findall((t or "").encode().lower())
            bad = {r.doc_id for r in before.collect() if any(tuple(w[k : k + 13]) in windows for w in [split(r.text)] for k in range(len(w)))}
            assert bad and ids == {r.doc_id for r in before.select("doc_id").collect()} - bad


def test_the_result_is_the_documents_in_their_shards(spark):
    docs = table(spark, SF, "documents").limit(90)
    got = stored(corpus_pipeline.shard(spark, docs, SF))
    assert got.select(*docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(got.select(*docs.columns)).isEmpty()
    rows = got.groupBy("shard").count().collect()
    assert len(rows) == 40 and sorted({r["count"] for r in rows}) == [2, 3]
    assert got.select("shard", "slot").distinct().count() == 90


def test_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    setting, none = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0)
    spark.conf.unset(setting)
    try:
        corpus_pipeline.keep_quality(spark, none.selectExpr("id doc_id", "'' text"), SF)
        wide = spark.range(3000).coalesce(1).selectExpr("repeat('long text ', 1000) text")
        assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) < 5 << 20
    finally:
        spark.conf.unset(setting)


def test_stages_keep_no_index_and_no_second_copy_of_texts(spark, tmp_path, monkeypatch):
    from filigree.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = table(spark, SF, "documents")
    for stage in (corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.drop_contaminated, corpus_pipeline.mix):
        stage(spark, docs, SF).count()
        left = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
        assert not [c for c in left if {"text", "grams", "keys", "terms"} & set(c)], (stage, left)


def test_mixed_rows_are_those_of_the_copies(spark):
    from filigree.llm import mixing

    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (None, None), (1, "another text"), (1, "another text"), (7, None)], "doc_id long, text string")
    docs, labels = stored(docs.union(odd)), table(spark, SF, "labels")
    told = mixing.mixture(docs, labels).select("doc_id", "copies").collect()
    want = sorted(str(r.doc_id) for r in told for _ in range(r.copies))
    assert sorted(str(r.doc_id) for r in mixing.mixed(docs, labels, ceiling=mixing.MOST).collect()) == want
