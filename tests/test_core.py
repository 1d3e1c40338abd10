"""Known values of single operators."""

import pytest
from pyspark.sql import functions as F

from filigree.functions import text as T
from filigree.operators import agent, chunking, evaluate, filings, search


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_tokens_and_html(spark):
    r = one(spark, "t string, h string, s string", ("Compute & Networking revenue in the 10-K", "<p>Item&nbsp;7.&nbsp;MD&amp;A</p><script>x</script>", "<td>Risk</td><td>Factors &#8217;s</td>"), T.tokens(F.col("t")), T.html_to_text(F.col("h")), T.unescaped(F.col("s")))
    assert r[0] == ["compute", "networking", "revenue", "10-k", "10", "k"]
    assert r[1] == "Item 7. MD&A" and r[2] == "Risk Factors 's"


def test_output_checks(spark):
    r = one(spark, "a string, c string, x string", ("It was $220.4 billion [1]", "about $215.9 billion", "Claim one [1]. Claim two [9]."), T.unsupported_numbers(F.col("a"), F.col("c")), T.citation_check(F.col("x"), F.lit(3)), T.is_refusal(F.lit(T.REFUSAL)), T.is_degenerate(F.lit("<your answer>")), T.truncated(F.lit("abcdef"), 4))
    assert r[0] == ["220.4"] and list(r[1]["invalid"]) == [9] and r[1]["cited_share"] == 1.0 and not r[1]["ok"]
    assert r[2] and r[3] and r[4] == "abcd\n...[truncated 2 chars]"


def test_metrics(spark):
    got, rel = F.col("g"), F.col("r")
    r = one(spark, "g array<string>, r array<string>", (["d3", "d7", "d1", "d9", "d2"], ["d1", "d2", "d5"]), evaluate.recall(got, rel, 5), evaluate.precision(got, rel, 5), evaluate.reciprocal_rank(got, rel), evaluate.hit(got, rel, 5), evaluate.recall(got, F.array().cast("array<string>"), 5))
    assert r[0] == pytest.approx(2 / 3) and r[1] == 0.4 and r[2] == pytest.approx(1 / 3) and r[3] == 1.0 and r[4] is None
    p = one(spark, "t array<string>", (["NVDA", "NVDA", "MSFT", "NVDA"],), evaluate.purity(F.col("t"), F.lit("NVDA"), 4))
    assert p[0] == 0.75


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "word " * 1200, "P "), (2, "", "P "), (3, "x" * 5000, "P ")], "id int, text string, prefix string")
    rows = chunking.word_windows(docs).where("id = 1").orderBy("chunk").collect()
    assert len(rows) == 3 and len(rows[0].text) > 2000
    assert {r.id for r in chunking.section_chunks(docs, 1000).collect()} == {1, 3}
    r = one(spark, "t string", ("aa bb cc dd",), chunking.hard_split(F.col("t"), 6))
    assert r[0] == ["aa bb", "cc dd"]


def test_search(spark):
    docs = spark.createDataFrame([(0, "H20 licence charge H20", "A"), (1, "cloud revenue", "B"), (2, "nothing here", "C")], "ord long, text string, ticker string")
    asked = spark.createDataFrame([(7, "H20")], "qid long, question string")
    assert [r.ord for r in search.top(search.bm25(asked, docs), 5).collect()] == [0]
    lists = search.fused(search.rank_lists(asked, docs))
    assert lists.count() == 3 and search.top(lists, 1).first().ord == 0
    rows = [(1, i, s, i, v) for i, (s, v) in enumerate([(0.9, [1.0, 0.0]), (0.89, [0.99, 0.1]), (0.5, [0.0, 1.0])])]
    picked = search.diversified(spark.createDataFrame(rows, "qid long, ord long, score double, rank int, embedding array<double>"), 2, 0.3)
    assert [r.ord for r in picked.orderBy("place").collect()] == [0, 2]


def test_growth_with_zero_before_is_null(spark):
    rows = spark.createDataFrame([("A", "R", "2023", 0, 110.0), ("A", "R", "2022", 1, 100.0), ("B", "R", "2023", 0, 5.0), ("B", "R", "2022", 1, 0.0)], "ticker string, concept string, end string, pos int, val double")
    got = {r.ticker: (r.value, r.yoy_growth) for r in filings.yearly_growth(rows).collect()}
    assert got == {"A": (110.0, 10.0), "B": (None, None)}


def test_agent_guards():
    tools = agent.Registry()

    @tools.register("adds")
    def add(a: int, b: int = 1) -> int:
        return a + b

    assert tools.problem("add", {}) == "missing: a (integer)" and tools.problem("add", {"a": 1}) is None
    assert tools.problem("add", {"a": "x", "c": 1}) == "not a parameter: c; wrong type: a takes integer, not str" and "'add'" in tools.problem("none", {})
    script = iter([{"tool": "add", "args": {"a": 1}}, {"tool": "add", "args": {"a": 1}}, {"tool": "no", "args": {}}, {"answer": "..."}, {"tool": "add", "args": {}}])
    out = agent.run_agent("q", lambda talk: next(script), tools)
    assert out.stopped == "error_budget" and out.used == ["add"] and [t["kind"] for t in out.trace] == ["result", "repeat", "invalid", "degenerate", "invalid"]
    assert agent.parsed_action('say ```{"tool": "add"}``` now') == {"tool": "add"} and agent.parsed_action("none") is None
    assert agent.parsed_action('{broken {"a": {"b": 1}} {"answer": "x"}') == {"answer": "x"} and agent.parsed_action('```json\n{"a": 1}\n```') == {"a": 1} and agent.parsed_action('so {"a": 1}') is None
    assert [t["name"] for t in tools.specs()] == ["add"] and tools.specs({"x"}) == [] and tools["add"].schema()["required"] == ["a"]
    assert agent.run_together(tools, [("add", {"a": 2}), ("add", {"a": None})])[0] == 3
    long = agent.run_agent("q", lambda talk: {"tool": "add", "args": {"a": len(talk)}}, tools, steps=3, allow={"add"})
    assert (long.stopped, long.steps, long.used) == ("max_steps", 3, ["add"] * 3)
    assert agent.run_agent("q", lambda talk: {"tool": "add", "args": {"a": 1}}, tools, allow=set(), errors=1).trace[0]["kind"] == "not_allowed"


def test_registry_imports_without_the_corpus_operators():
    import __spark_entry__ as e

    from filigree.oracle import ORACLE
    from filigree.queries import QUERIES

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(QUERIES)


def test_nearest_rank_and_answer_rates(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 3.0), ("b", 3.0), ("c", None)], "kind string, value double")
    assert {r.kind: r.value for r in evaluate.nearest_rank(rows, "kind", "value", 0.95).collect()} == {"a": 19.0, "b": 3.0}
    cases = [
        (1, "It was 5.2% [1].", "the 5.2 it", ["IT"], False, 1, ["x"], "x"),
        (2, "It was 5.3% [2].", "the 5.2 it", ["gone"], False, 1, ["x", "y"], "x"),
        (3, "I could not find this in the filings provided.", "", ["it"], True, 0, [], None),
    ]
    checked = evaluate.answer_checks(spark.createDataFrame(cases, "id int, answer string, context string, must_include array<string>, should_refuse boolean, n_sources int, tickers array<string>, asked string"))
    assert {r.id: r.passed for r in checked.collect()} == {1: True, 2: False, 3: True}
    r = evaluate.generation_rates(checked).first()
    assert (r.pass_rate, r.context_contains_rate, r.numeric_grounded_rate, r.ticker_correct_rate, r.n) == (0.667, 0.5, 0.5, 0.5, 3)


def test_a_question_without_hits_abstains(spark):
    from filigree.plans import ladder

    questions = spark.createDataFrame([(1, "zebra stripes"), (2, "nothing of it")], "qid int, question string")
    passages = spark.createDataFrame([(1, "zebra stripes here", "t1", "1"), (2, "other words", "t2", "1")], "ord int, text string, ticker string, item string")
    scope = spark.createDataFrame([(1, None), (2, "none")], "qid int, scope string")
    found = ladder.hits(ladder.LADDER[4], questions, passages, scope).collect()
    assert [(r.ord, r.abstain) for r in found if r.qid == 2] == [(None, True)]
    assert [r.abstain for r in found if r.qid == 1][0] is False and {r.config for r in found} == {"V4"}


def test_tfidf_top_is_the_top_of_all_pairs(spark, monkeypatch):
    texts = ["red fox", "red red fox", None, "", "blue sea fox", "sea", "red fox"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "sea of blue"), (3, "none of it"), (4, ""), (5, None)], "qid long, question string")
    monkeypatch.setattr(search, "BLOCK", 2)
    rows = lambda df: sorted((r.qid, r.rank, r.ord, r.score) for r in df.collect())
    for k in (1, 2, 10):
        assert rows(search.tfidf_top(asked, docs, k)) == rows(search.top(search.tfidf_scores(asked, docs), k))


def test_resolved_meets_tickers_by_words(spark):
    asked = spark.createDataFrame([(1, "what of brk.b?"), (2, "abcd"), (3, "AB-C, then ZZ"), (4, None), (5, "the company Acme")], "qid long, question string")
    names = spark.createDataFrame([("BRK.B",), ("ABC",), ("ZZ",), ("AB-C",)], "ticker string")
    got = {r.qid: r.scope for r in search.resolved(asked, names, {"ACME": "ZZ", "WHAT": "NONE"}).collect()}
    assert got == {1: "BRK.B", 2: None, 3: "AB-C", 4: None, 5: "ZZ"}
