"""Personal data by weak supervision; only DataFrame operations.

Spans are candidates of a kind. Base kinds (email, ip, card, phone) are found by the patterns of the
contract, leftmost and non-overlapping, and always stay; the added kinds need the final classifier's word.
Five labelers vote (1 for, -1 against, 0 abstains) on every candidate: strict form, gazetteer of known
beginnings and endings, words of context before it, words that speak against it, and variety of signs.
Expectation-maximisation over the counts of vote patterns in all documents, with base spans as known
positives, estimates each labeler's reliability; its posteriors train a logistic span classifier over kind, votes and length. There are
at most kinds * 3 ** 5 * 4 patterns whatever the input, so the counts are sent to the driver; everything
else is column expressions. An added span is kept if it scores 0.5 or more and overlaps no base span.

Patterns use possessive repeats and look-behinds so that a long run of signs costs one pass and no
recursion; they match the same spans as the plain forms in the contract.

Positions are code points, end exclusive. Null text counts as empty. Null doc_id and repeated rows: a
result row for each. Empty table: empty result. Whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import stored

LOCAL = "A-Za-z0-9._%+-"
#: Base kinds: pattern, and a sign that any match contains ("" for digits).
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?![A-Za-z0-9])", ""),
    "local_phone": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", ""),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]{2,}+", ""),
    "secret": (r"(?<=password=)[0-9A-Za-z]{8,}+|(?<=token = \")[0-9A-Za-z]{16,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", ""),
}
KINDS = [*BASE, *ADDED]
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Gazetteer of given and family names. Fixed values.
NAMES = (
    "Anna Ana Carlos Carmen Claire David Elena Emma Hans Jean John José Juan Julia Klaus Luis Marie María Mary Michael Paul Peter Pierre Sophie Thomas "
    "Bernard Brown Davis Dubois Durand Fischer García Garcia González Gonzalez Johnson Jones López Lopez Martin Martínez Martinez Meyer Miller Moreau "
    "Müller Petit Rodríguez Rodriguez Sánchez Sanchez Schmidt Schneider Smith Weber Williams Wilson"
).split()
#: Per kind: strict form, gazetteer, context before, context against. Fixed values.
LABELERS = {
    "email": (r"^[^.@][^@]*[^.@]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$", r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", r"mail|contact|write|schreib|écri|escrib", r"git|ssh|://$"),
    "ip": (r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$", r"^(?!0\.|127\.|255\.)", r"\bip\b|addr|host|server|login|from", r"version|\bv$|section|chapter|§"),
    "card": (r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$", r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"card|visa|master|karte|carte|tarjeta|credit", r"isbn|order|serial|tracking"),
    "phone": (r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}$", r"^\+(?:1|33|34|44|49|39|31|32|41|43)(?![0-9])", r"phone|call|tel|mobil|fax|contact|anruf|appel|llam", r"offset|utc|gmt"),
    "iban": (r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]+$", r"^(?:DE|FR|ES|GB|IT|NL|BE|CH|AT|PT|IE|PL)", r"iban|account|konto|compte|cuenta|bank", r"serial|model"),
    "local_phone": (r"^\([0-9]{3}\)\x20|^[0-9]{3}([.-])[0-9]{3}\1", r"^\(?[2-9]", r"phone|call|tel|mobil|fax|contact|anruf|appel|llam", r"isbn|order|part|serial"),
    "national_id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[0-7]", r"ssn|social|insur|\bid\b|ident", r"isbn|order|part|serial|phone"),
    "person": (r"^[A-Z][a-z]+\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+$", rf"(?:{'|'.join(NAMES)})$", r"dear|name|contact|signed|by", r"brand|product"),
    "secret": (r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", r"^(?:AKIA|ghp|sk)", r"password|passwd|token|secret|key", r"example|dummy|sha256|checksum"),
}
VOTES = ("form", "listed", "context", "against", "variety")
AROUND, CHUNK = 40, 256
SPAN = "struct<s:int,e:int,t:string,c:string>"


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, sign: str) -> Column:
    """All matches of pattern as array<struct<s, e, t, c>>, c: the AROUND signs before it.

    Positions add up over the pieces between matches: first over chunks of CHUNK matches, then inside each chunk, so
    that no fold carries a long array and the work is linear in the number of matches but for a tiny share.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = bound(matches, lambda found: F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p"))))
    none = F.array().cast(f"array<{SPAN}>")
    tail = lambda *parts: F.right(F.concat(*parts), F.lit(AROUND))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        before = tail(acc["tail"], x["p"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t"), before.alias("c")).cast(SPAN))
        return F.struct(e.alias("at"), tail(before, x["m"]).alias("tail"), F.concat(acc["out"], one).alias("out"))

    def begin(acc, chunk):
        size = F.aggregate(chunk, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["m"]))
        last = tail(F.array_join(F.transform(chunk, lambda x: F.concat(x["p"], x["m"])), ""))
        here = F.array(F.struct(acc["at"].alias("at"), acc["tail"].alias("tail")))
        return F.struct((acc["at"] + size).alias("at"), last.alias("tail"), F.concat(acc["out"], here).alias("out"))

    def chunked(found):
        starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
        return F.when(F.size(found) > 0, bound(F.transform(starts, lambda k: F.slice(found, k * CHUNK + 1, F.lit(CHUNK))), placed)).otherwise(none)

    def placed(chunks):
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,tail:string>>").alias("out"))
        begins = F.aggregate(chunks, start, begin, lambda acc: acc["out"])
        inside = lambda chunk, b: F.aggregate(chunk, F.struct(b["at"].alias("at"), b["tail"].alias("tail"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, begins, inside))

    here = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]" if "A-ZÀ" not in pattern else "[A-Z]")
    return F.when(here, bound(pairs, chunked)).otherwise(none)


def meets(own: Column, x: Column) -> Column:
    """Whether span x overlaps one of own, which is in order and without overlaps: the last that begins before x ends, by bisection."""

    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.get(own, middle)["s"] < x["e"]
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~before, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda acc: acc["lo"])
    return F.coalesce(F.get(own, found - 1)["e"] > x["s"], F.lit(False))


def valid(kind: str, found: Column) -> Column:
    digits = lambda x: F.regexp_replace(x["t"], "[^0-9]", "")
    if kind == "ip":
        return F.filter(found, lambda x: x["t"].rlike(OCTETS))
    if kind == "card":
        return F.filter(found, lambda x: F.call_function("luhn_check", digits(x)))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(digits(x)).between(8, 15))
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """docs without text, with filigree_spans: array of (kind, s, e, base, votes, long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("text", text)
    for kind, (pattern, sign) in {**BASE, **ADDED}.items():
        out = out.withColumn(f"filigree_{kind}", valid(kind, spans(F.col("text"), pattern, sign)))
    def seen(kind):
        form, listed, context, against = LABELERS[kind]
        low = lambda x: F.lower(x["c"])
        vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)

        def one(x):
            form_, listed_ = x["t"].rlike(form), x["t"].rlike(listed)
            signs = F.size(F.array_distinct(F.split(x["t"], "")))
            votes = (vote(form_, ~form_), vote(listed_, None), vote(low(x).rlike(context), None), -vote(low(x).rlike(against), None), vote(signs >= 6, signs < 4))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind in BASE).alias("base"), *[v.cast("int").alias(n) for v, n in zip(votes, VOTES, strict=True)], F.least(F.lit(3), F.floor((x["e"] - x["s"]) / 12)).cast("int").alias("long"))

        own = F.col(f"filigree_{kind}")
        if kind in ADDED:
            own = F.filter(own, lambda x: ~reduce(or_, (meets(F.col(f"filigree_{k}"), x) for k in BASE)))
        return F.transform(own, one)

    every = F.flatten(F.array(*[seen(k) for k in KINDS]))
    return out.select(*[F.col(c) for c in docs.columns if c != "text"], every.alias("filigree_spans"))


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """Posterior of each pattern and each labeler's P(vote | class), by expectation-maximisation from the majority vote.

    patterns: (votes, count, base). Spans of base kinds are known to be right. Each labeler starts with a tenth
    of the spans as prior belief that its votes lean to the truth, so the classes cannot swap.
    """
    belief = 1.0 + 0.1 * sum(n for _, n, _ in patterns)
    lean = {1: {1: 0.5, 0: 0.4, -1: 0.1}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
    post = [1.0 if base else min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _, base in patterns]
    tables: list[dict] = []
    for _ in range(rounds):
        prior = [belief, belief]
        tables = [{(y, v): belief * lean[y][v] for y in (0, 1) for v in (-1, 0, 1)} for _ in VOTES]
        for (votes, n, _), p in zip(patterns, post, strict=True):
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                prior[y] += w
                for j, v in enumerate(votes):
                    tables[j][y, v] += w
        for t in tables:
            for y in (0, 1):
                total = sum(t[y, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    t[y, v] /= total
        post = []
        for votes, _, base in patterns:
            odds = math.log(prior[1] / prior[0]) + sum(math.log(t[1, v] / t[0, v]) for t, v in zip(tables, votes, strict=True))
            post.append(1.0 if base else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post, tables


def row_of(kind: str, votes: tuple, long: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *map(float, votes), float(long)]


def classifier(patterns: list[tuple], steps: int = 30) -> list[float]:
    """Weights of a logistic span classifier from (kind, votes, long, count) rows and their posteriors; penalised Newton steps."""
    import numpy as np

    w = np.zeros(2 + len(KINDS) + len(VOTES))
    if not patterns:
        return list(w)
    post, _ = reliabilities([(p[1], p[3], p[0] in BASE) for p in patterns])
    x, y = np.array([row_of(*p[:3]) for p in patterns]), np.array(post)
    n = np.array([math.log1p(p[3]) for p in patterns])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.1 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, slope), -3, 3)
    return [float(v) for v in w]


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, found): found is the array of (kind, s, e, base, score) of each document, by kind in KINDS order, then start."""
    table = stored(candidates(docs.select("doc_id", "text")))
    one = table.select(F.explode("filigree_spans").alias("c")).select("c.*")
    counts = one.groupBy("kind", *VOTES, "long").agg(F.count("*").alias("n")).orderBy("kind", *VOTES, "long").collect()
    w = classifier([(r["kind"], tuple(r[v] for v in VOTES), r["long"], r["n"]) for r in counts])
    at = 1 + len(KINDS)
    of_kind = F.create_map(*[F.lit(v) for pair in zip(KINDS, w[1:at], strict=True) for v in pair])

    def scored(x):
        z = F.lit(w[0]) + of_kind[x["kind"]] + sum((x[v] * w[at + j] for j, v in enumerate(VOTES[1:], 1)), x[VOTES[0]] * w[at]) + x["long"] * w[-1]
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), (1 / (1 + F.exp(-z))).alias("score"))

    found = F.filter(F.transform("filigree_spans", scored), lambda x: x["base"] | (x["score"] >= 0.5))
    return table.select("doc_id", found.alias("found"))
