"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased; each run of signs that are no letters becomes one space. For each language an
order-4 model is trained on a bounded sample (`rows` documents a language, those with the smallest hash of
doc_id). Models are sorted arrays of 64-bit n-gram hashes beside log-probabilities (seen n-grams) and
back-off weights (seen contexts). A text takes the language of the lowest cross-entropy per character;
its score is the softmax of the cross-entropies. It is rejected if its cross-entropy is above that of
99 in 100 calibration documents of the language, which are sampled documents kept out of training.

Null text, or none with a letter: language `und`, score 0. Ties: the first language in sorted order.
Rows without doc_id are predicted but never learned from. No labelled row: all `und`. Whole texts are
read; extra columns are kept.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import per_text

ORDER, ROWS, DISCOUNT, LANGUAGES = 4, 1200, 0.75, 256
PRIME = 0x9E3779B97F4A7C15


def cleaner():
    import re

    gap = re.compile(r"[\W\d_]+")

    def clean(text):
        out = gap.sub(" ", (text or "").lower()).strip()
        if out and not out.replace(" ", "").isalpha():  # numbers of other forms, such as ½
            out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
        return f" {out} "

    return clean


def gram_keys(codes, order: int):
    """For each position, the hash of the `order` characters that end there (only where they lie inside)."""
    import numpy as np

    prime = np.uint64(PRIME)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - order + 1, np.uint64)
        for j in range(order):
            out = out * prime + codes[j : len(codes) - order + 1 + j]
        return out


def model_of(texts: list[str], order: int = ORDER, discount: float = DISCOUNT) -> list[tuple]:
    """[(sorted keys, log-probabilities, sorted context keys, log back-off weights)] for n-grams of 1 to order characters.

    The highest order counts n-grams; each lower one counts the different characters before an n-gram.
    """
    import numpy as np

    clean = cleaner()
    joined = "".join(clean(t) for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = len(np.unique(codes)) + 1
    grams = {}
    for n in range(1, order + 1):
        keys, at, counts = np.unique(gram_keys(codes, n), return_index=True, return_counts=True)
        grams[n] = [keys, at, counts.astype(float)]
    for n in range(1, order):
        # each different (n+1)-gram is one different character before its last n characters
        longer = grams[n + 1]
        tails = gram_keys(codes, n)[longer[1] + 1]
        keys, counts = np.unique(tails, return_counts=True)
        found = np.zeros(len(grams[n][0]))
        found[np.searchsorted(grams[n][0], keys)] = counts
        grams[n][2] = np.maximum(found, 1e-9)
    levels, lower = [], None
    for n in range(1, order + 1):
        keys, at, counts = grams[n]
        if n == 1:
            total = counts.sum()
            kept = np.maximum(counts - discount, 0) / total
            weight = 1 - kept.sum()
            p = kept + weight / size
            levels.append((keys, np.log(p), np.zeros(1, np.uint64), np.log(np.array([weight / size]))))
        else:
            heads = gram_keys(codes, n - 1)[at]
            context, which = np.unique(heads, return_inverse=True)
            total = np.bincount(which, weights=counts)
            kept = np.maximum(counts - discount, 0) / total[which]
            weight = np.maximum(1 - np.bincount(which, weights=kept), 1e-12)
            tails = gram_keys(codes, n - 1)[at + 1]
            p = kept + weight[which] * np.exp(lower(tails))
            levels.append((keys, np.log(p), context, np.log(weight)))
        last_keys, last_p = levels[-1][0], levels[-1][1]
        lower = lambda k, a=last_keys, b=last_p: b[np.searchsorted(a, k)]  # noqa: E731  every tail of a seen n-gram is seen
    return levels


def find(sorted_keys, keys):
    import numpy as np

    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def log_probability(levels: list[tuple], keys: list):
    """keys[n - 1]: hashes of the last n characters; contexts are the hashes one level below, one place earlier."""
    import numpy as np

    uni, p, _, unknown = levels[0]
    at, hit = find(uni, keys[0][1])
    out = np.where(hit, p[at], unknown[0])
    for n in range(2, len(levels) + 1):
        grams, p, context, weight = levels[n - 1]
        head, gram = keys[n - 1]
        at, hit = find(context, head)
        out = np.where(hit, weight[at] + out, out)
        at, hit = find(grams, gram)
        out = np.where(hit, p[at], out)
    return out


def cross_entropies(models: list[list[tuple]], texts: list[str], order: int = ORDER):
    """(cross-entropy a character for each text and model, whether the text has a letter)."""
    import numpy as np

    clean = cleaner()
    cleaned = [clean(t) for t in texts]
    # order - 1 blanks before a text: its first characters have contexts of blanks
    joined = "".join(" " * (order - 1) + c for c in cleaned)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(c) for c in cleaned])
    starts = np.concatenate(([0], np.cumsum(lengths + order - 1)))[:-1]
    full = gram_keys(codes, order)
    keys, first, which = np.unique(full, return_index=True, return_inverse=True)
    ends = first + order - 1
    pairs = []
    for n in range(1, order + 1):
        own = gram_keys(codes, n)
        head = gram_keys(codes, n - 1)[ends - n + 1] if n > 1 else None
        pairs.append((head, own[ends - n + 1]))
    used = np.zeros(len(full) + 1, bool)
    for s, n in zip(starts, lengths, strict=True):
        used[s : s + n] = True
    out = np.empty((len(texts), len(models)))
    for k, levels in enumerate(models):
        each = np.where(used[:-1], log_probability(levels, pairs)[which], 0.0)
        out[:, k] = -np.add.reduceat(np.concatenate((each, [0.0])), starts) / lengths
    return out, np.array([any(ch != " " for ch in c) for c in cleaned], bool)


@dataclass
class Languages:
    """names: sorted; models: for each name the levels of model_of(); limits: cross-entropy above which a text is rejected."""

    names: list[str]
    models: list
    limits: list[float]

    def predict(self, spark, text: Column) -> Column:
        """A struct column: lang, score, cross_entropy, rejected."""
        held = spark.sparkContext.broadcast(pickle.dumps((self.names, self.models, self.limits)))  # bounded by the sample

        def work():
            import numpy as np
            import pyarrow as pa

            names, models, limits = pickle.loads(held.value)
            limits = np.array(limits)

            def each(texts):
                if not texts or not names:
                    lang, score, entropy, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    got, letters = cross_entropies(models, texts)
                    best = got.argmin(axis=1)
                    odds = np.exp(-10 * (got - got.min(axis=1, keepdims=True)))
                    score = np.where(letters, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                    entropy = got.min(axis=1)
                    lang = [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    rejected = ~letters | (entropy > limits[best])
                return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["lang", "score", "cross_entropy", "rejected"])

            return each

        return per_text(work, "lang string, score double, cross_entropy double, rejected boolean")(text)


def fitted(docs: DataFrame, keep: Column | None = None, rows: int = ROWS) -> Languages:
    """Learns from at most `rows` documents of each lang that keep holds for; a fifth of them calibrates rejection.

    More than LANGUAGES different values of lang are refused with an error: the models go to every task.
    """
    spark = docs.sparkSession
    from_rows = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null")
    if keep is not None:
        from_rows = from_rows.where(keep)
    sizes = from_rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # The smallest `rows` hashes of a language lie among those below twice their expected reach, so only these are sorted.
    near = F.xxhash64("doc_id") / 2.0**64 + 0.5 < (2.0 * rows + 100) / F.col("n")
    sizes = spark.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long")
    from_rows = from_rows.join(F.broadcast(sizes), "lang").where(near).select("doc_id", "lang").distinct()
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = from_rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= rows)
    ids = ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "place")
    texts = docs.select("doc_id", "lang", "text").where("text is not null")
    sample = texts.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of"))).select("lang", "place", "text")

    def learn(group):
        import pyarrow as pa

        texts = [t for t, p in zip(group.column("text").to_pylist(), group.column("place").to_pylist(), strict=True) if p % 5]
        if not any(ch.isalpha() for t in texts for ch in t):
            return pa.table({"lang": pa.array([], pa.string()), "model": pa.array([], pa.binary())})
        return pa.table({"lang": pa.array(group.column("lang").to_pylist()[:1], pa.string()), "model": pa.array([pickle.dumps(model_of(texts))], pa.binary())})

    got = sorted(sample.groupBy("lang").applyInArrow(learn, "lang string, model binary").collect(), key=lambda r: r["lang"])
    out = Languages([r["lang"] for r in got], [pickle.loads(r["model"]) for r in got], [float("inf")] * len(got))
    if got:
        seen = sample.where("place % 5 = 0").select("lang", out.predict(spark, F.col("text")).alias("p"))
        # No filter on p: it would move below the join, and every document would be predicted.
        own = F.when(F.col("p.lang") == F.col("lang"), F.col("p.cross_entropy"))
        limits = {r["lang"]: r["most"] for r in seen.groupBy("lang").agg(F.percentile(own, F.lit(0.99)).alias("most")).collect()}
        out.limits = [float("inf") if limits.get(n) is None else limits[n] for n in out.names]
    return out


def identified(docs: DataFrame, model: Languages) -> DataFrame:
    """docs with a struct column filigree_lang: lang, score, cross_entropy, rejected."""
    return docs.withColumn("filigree_lang", model.predict(docs.sparkSession, F.col("text")))
