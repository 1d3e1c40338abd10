"""Mixing sources to target weights with soft membership.

Domains are classes of the labelled table: `low` (quality 0), `toxic` (toxic 1, quality not 0), `clean`.
A linear classifier (see linear; presence features), trained on at most `rows` labelled documents, gives
each document posteriors over domains. Its expected tokens in a domain are tokens * posterior * rate. The rates
are nonnegative and start at 1; projected-gradient least squares moves them until the expected domain totals are
the targets: shares of all tokens. A scarce domain's documents get rates above 1, that is, copies, up to the
`ceiling` MOST. With a ceiling of 1 mixing is a filter: the total is then the one at which the first domain, `clean`,
keeps its whole supply, and the goal of a domain that has less than its share of it is what it has. A domain without tokens has no goal. Each step
is one distributed sum over all documents: residual and domain Gram matrix (domains x domains) come to the driver,
the gradient scaled by that matrix goes back as a vector, and a document's rate moves by its product with the
posteriors. Rates are thus a function of the text. A fit that misses its goals is taken with a warning (`strict`: an
error); `Fit` has the goals and the totals that were reached.

A document of rate r is kept r times on average: floor(r) times, and once more if the hash of its doc_id,
as a fraction, is below the rest. Tokens are runs of signs between ASCII white space. Null or empty text: no
tokens; it has posteriors and a rate, and moves no total. Null doc_id: hashed as null, as any value. Without
a labelled row the posteriors are equal and the rates stay at 1. Repeated rows share a fate, and so do ties: rates
depend on the text alone. Very long texts are read whole. Empty tables: no rows, or no labels.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import labelled_sample, per_text, stored
from filigree.llm.linear import Linear, presence, trained

DOMAINS = ("clean", "toxic", "low")
TARGETS = (0.95, 0.03, 0.02)
ROWS, STEPS, CLOSE = 6000, 24, 1e-4
#: No document is repeated more than so often.
MOST = 4.0
#: Columns of our own, of names that no input has.
MARK, COUNT, HASHED = "filigree_m_4e1f", "filigree_n_4e1f", "filigree_h_4e1f"


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the number of the domain; labels without both marks are left out."""
    y = F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0)
    return labels.where("quality is not null and toxic is not null").select("doc_id", y.alias("y"))


def classifier(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Linear:
    return trained(labelled_sample(docs, domain_labels(labels), rows), len(DOMAINS), features=presence, alpha=0.3, l1=0.3)


def with_posteriors(docs: DataFrame, model: Linear) -> DataFrame:
    """docs with filigree_m: p (posterior of each domain, of sum 1) and tokens, both from one pass over the text."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights)  # classes * 2 ** BITS * 4 bytes

    def work():
        import numpy as np
        import pyarrow as pa

        of, w = presence().of, np.ascontiguousarray(held.value.T)
        k = w.shape[1]

        def each(texts):
            out, tokens = np.empty((len(texts), k)), np.empty(len(texts), np.int64)
            for i, t in enumerate(texts):
                words = t.encode().split() if t else ()
                tokens[i] = len(words)
                out[i] = 0.3 * w[of(words)].sum(axis=0, dtype=np.float64) + 0.7 * w[0]
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            out /= out.sum(axis=1, keepdims=True)
            p = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * k, pa.array(out.ravel()))
            return pa.StructArray.from_arrays([p, pa.array(tokens)], names=["p", "tokens"])

        return each

    return docs.withColumn(MARK, per_text(work, "struct<p:array<double>,tokens:bigint>")(F.col("text")))


@dataclass
class Fit:
    """The steps of the rates, and the expected tokens of each domain that were wanted and that they give."""

    moves: list[list[float]]
    goal: list[float]
    reached: list[float]
    ceiling: float


def rate(p: Column, moves: list[list[float]], ceiling: float = MOST) -> Column:
    """The rate after the given steps: from 1, minus posteriors times move, kept from 0 to the ceiling each time."""
    at = F.lit(min(1.0, ceiling))
    if not moves:
        return at
    steps = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    dot = lambda m: sum((p[k] * m[k] for k in range(1, len(moves[0]))), p[0] * m[0])
    return F.aggregate(steps, at, lambda r, m: F.greatest(F.lit(0.0), F.least(F.lit(ceiling), r - dot(m))))


def fitted(scored: DataFrame, targets=TARGETS, ceiling: float = MOST, steps: int = STEPS, strict: bool = False) -> Fit:
    """Projected gradient for scored (filigree_m), until totals are within CLOSE of all tokens of their goals."""
    import numpy as np

    k, p, t = len(targets), F.col(MARK)["p"], F.col(MARK)["tokens"]
    share = np.array(targets, float) / sum(targets)
    fit, gaps = Fit([], [], [], ceiling), []
    for _ in range(steps + 1):
        inside = F.when((F.col("r") > 0) & (F.col("r") < ceiling), 1.0).otherwise(0.0)
        sums = [F.sum(t * p[i] * F.col("r")).alias(f"a{i}") for i in range(k)]
        gram = [F.sum(t * p[i] * p[j] * (inside + 1e-3)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        row = scored.select(MARK, rate(p, fit.moves, ceiling).alias("r")).agg(*sums, *gram).first()
        have = np.array([row[f"a{i}"] or 0.0 for i in range(k)])
        if not fit.goal:
            there = np.where(have > 1e-9 * have.sum(), share, 0.0)
            goal = there / max(there.sum(), 1e-300) * have.sum() if ceiling > 1 else np.minimum(share * have[0] / share[0], have)
            fit.goal = goal.tolist()
        gap = have - goal
        fit.reached = have.tolist()
        if goal.sum() <= 0 or np.abs(gap).max() <= CLOSE * goal.sum():
            return fit
        gaps.append(float(np.abs(gap).max()))
        if len(gaps) > 4 and min(gaps[-3:]) > 0.98 * min(gaps[:-3]):
            break  # the goals are out of reach: three steps came no closer
        g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        if ceiling <= 1 and not fit.moves:  # all rates are at the ceiling: any of them may move
            g = g * 1e3
        g += np.eye(k) * 1e-6 * max(g.trace(), 1e-9) / k
        fit.moves.append([float(x) for x in np.linalg.solve(g, gap)])
    else:
        fit.moves.pop()  # the last one was not looked at
    said = f"expected tokens {fit.reached} miss their goals {fit.goal} after {len(fit.moves)} steps"
    if strict:
        raise ValueError(said)
    warnings.warn(said, stacklevel=2)
    return fit


def copies(doc_id: str, r: Column) -> Column:
    """How often a document of rate r is kept."""
    chance = F.pmod(F.xxhash64(F.lit(41), doc_id), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + F.when(chance < r - F.floor(r), 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, targets=TARGETS, ceiling: float = MOST) -> DataFrame:
    """(doc_id, tokens, a posterior for each domain, rate, copies) for each document."""
    model = classifier(docs, labels)
    scored = stored(with_posteriors(docs.select("doc_id", "text"), model).drop("text"))
    p = F.col(MARK)["p"]
    moves = fitted(scored, targets, ceiling).moves if model.rows else []
    out = scored.withColumn("rate", rate(p, moves, ceiling))
    return out.select("doc_id", F.col(MARK)["tokens"].alias("tokens"), *[p[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies("doc_id", F.col("rate")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets=TARGETS, ceiling: float = 1.0) -> DataFrame:
    """docs, each row as often as its copies say; as a filter by default (no rate above 1)."""
    model = classifier(docs, labels)
    if not model.rows:
        return docs
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias(HASHED))
    scored = stored(with_posteriors(texts, model).drop("text"))
    r = rate(F.col(MARK)["p"], fitted(scored, targets, ceiling).moves, ceiling)
    n = scored.groupBy("doc_id", HASHED).agg(F.first(MARK).alias(MARK)).select("doc_id", HASHED, copies("doc_id", r).alias(COUNT)).where(F.col(COUNT) > 0)
    # Texts are not written a second time: each row finds its copies by doc_id and the hash of its text.
    same = docs["doc_id"].eqNullSafe(n["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(n[HASHED])
    if ceiling <= 1:
        return docs.join(n, same, "left_semi")
    kept = docs.join(n, same).select(*[docs[c] for c in docs.columns], COUNT)
    return kept.withColumn(COUNT, F.explode(F.sequence(F.lit(1), COUNT))).select(*docs.columns)
