"""The SQL of op7 and op9 against their queries, on nulls, empty texts, repeated rows, ties and runs of many lengths."""

import duckdb
import pytest

from filigree.llm.queries import ORACLE, QUERIES

RUN = [f"this is line number {i} of a passage that comes again" for i in range(9)]
ITEM = "Alpha beta gamma delta, epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
DOCS = [
    (1, "\n".join(["own start", *RUN, "own end"])),
    (2, "\n".join([*RUN[2:7], "something else", RUN[0]])),
    (2, "\n".join([*RUN[2:7], "something else", RUN[0]])),
    (3, "\n".join(RUN * 8)),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (None, "\n".join(RUN[:3])),
    (7, f"before {ITEM.upper()} after"),
    (8, ITEM + " " + " ".join(f"w{i}" for i in range(900))),
    (9, "a short one, and a short one again"),
    (11, ITEM.replace("theta", "theta put in")),
    (12, "iota " + ITEM.replace("kappa ", "").replace(" pi", "")),
]
BENCH = [(1, ITEM), (2, "a SHORT one"), (10, ITEM + " sigma"), (3, None), (4, "..."), (2, "other text of two")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, name):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    assert len(rows) == len(DOCS)
