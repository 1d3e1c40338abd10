import random
import re

from filigree.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("0123456789.-+ @a_%()ü\U0001f600") for _ in range(rng.randrange(0, 120)))) for i in range(400)]
    rows += [(1000, "4111 1111-11111111 4111111111111111"), (1001, None), (1002, ""), (1003, "a@b.c_x@d.e f@g.h..x@d.e"), (1004, "1.2.3.4.5 999.1.1.1 007.1.1.1"), (1004, "mail me: jo@ex.com"), (None, "+1 (555) 123-4567")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, found int")
    got = pii.personal_data(docs).collect()
    base = sorted((r.doc_id if r.doc_id is not None else -1, [(x.kind, x.s, x.e) for x in r.found if x.base]) for r in got)
    assert base == sorted((i if i is not None else -1, plain(t or "")) for i, t in rows)


def test_long_runs_need_no_recursion(spark):
    texts = ["1" * 50000, "1 " * 30000, "a" * 100000, "+" + "(" * 50000, "x@" + "b." * 30000 + "c"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [x.kind for x in r.found if x.base] for r in rows}[4] == ["email"] and len(rows) == 5


def test_added_spans_and_votes(spark):
    texts = [f"please mail contact{i}@host.com or call +1 (555) 123-45{i:02d} now, login password=7602ad27cf55{i:02d}de ok" for i in range(20)] + ["no data here"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {r.doc_id: [x.kind for x in r.found] for r in rows}
    assert kinds[0] == ["email", "phone", "secret"] and kinds[20] == []
    post, tables = pii.reliabilities([((1, 1, 1, 0, 1), 50, True), ((-1, 0, 0, -1, -1), 20, False), ((1, 0, 1, 0, 1), 5, False)])
    assert post[0] == 1.0 and post[1] < 0.5 < post[2] and tables[0][1, 1] > tables[0][0, 1]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
