"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text, hashed into 2 ** BITS places: its words and word pairs (lower case), and their shapes
(runs of upper and lower case letters, digits, and each other sign) with shape pairs. A text is a sparse
vector of unit length plus a constant; its score is the logistic function of one sparse dot product.

Training reads a bounded sample (`rows` labelled documents, those with the smallest hash of doc_id) in one
task, in the order of that hash, `epochs` times. An empty or null text has the constant alone. Without a
labelled row the model is empty (`rows` = 0) and every score is 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import WordIds, frugal, per_text

BITS, ROWS, EPOCHS = 18, 6000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.0


class Kinds(dict):
    """Code point -> sign of its kind, for str.translate."""

    def __missing__(self, point):
        c = chr(point)
        self[point] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


KINDS, RUN = Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The kinds of a word's signs, runs as one sign."""
    if word.isalpha() and word.islower():
        return "a"
    return RUN.sub(r"\1", word.translate(KINDS))


def word_id(word: str) -> int:
    from zlib import crc32

    return crc32(word.lower().encode()) << 32 | crc32(shape(word).encode())


def featurizer(bits: int = BITS):
    """text -> (places, values)."""
    import numpy as np

    ids = WordIds(word_id)
    mask, mul = np.uint64((1 << bits) - 1), np.uint64(0x9E3779B97F4A7C15)
    salt = [np.uint64(x * 0x632BE59BD9B4E019 & (1 << 64) - 1) for x in (1, 2, 3, 4)]

    def places(text):
        words = (text or "").split()
        if not words:
            return np.zeros(1, np.int64), np.ones(1)
        both = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
        word, look = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        grams = [word + salt[0], (word[:-1] * mul ^ word[1:]) + salt[1], look + salt[2], (look[:-1] * mul ^ look[1:]) + salt[3]]
        hashed = np.concatenate(grams) * mul
        at, n = np.unique(((hashed ^ (hashed >> np.uint64(29))) * mul >> np.uint64(64 - bits)) & mask, return_counts=True)
        values = np.sqrt(n)
        return np.concatenate(([0], at.astype(np.int64))), np.concatenate(([1.0], values / np.sqrt(n.sum())))

    return places


def presence(bits: int = BITS):
    """text (or its UTF-8) -> (places, values): which words, beginnings of five letters and word shapes it has, all of one weight.

    The function's attribute `of` takes the words of a text as bytes.
    """
    import numpy as np
    from zlib import crc32

    most = (1 << bits) - 1
    place = lambda x: 1 + crc32(x.encode()) % most

    def make(data):
        word = data.decode()
        own, look = word.lower().strip(".,;:!?\"'()[]"), shape(word)
        return place(own), place("<" + own[:5]), place("#" + look)

    ids = WordIds(make)

    def of(words):
        got = set().union(*map(ids.__getitem__, set(words)))
        got.add(0)
        return np.fromiter(got, np.int64, len(got))

    def places(text):
        at = of((text or "").encode().split())
        return at, np.where(at == 0, 1.0, 0.3)

    places.of = of
    return places


def ftrl(rows, classes: int, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1):
    """Weights (classes, 2 ** bits) from [(places, values, targets)]; targets: an array of 0 or 1 for each class."""
    import numpy as np

    z, n, w = (np.zeros((classes, 1 << bits)) for _ in range(3))
    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[:, at], n[:, at]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / alpha + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y)[:, None] * x
            more = ni + g * g
            z[:, at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * wi
            n[:, at] = more
    for k in range(classes):
        w[k] = np.where(np.abs(z[k]) <= l1, 0.0, (np.sign(z[k]) * l1 - z[k]) / ((BETA + np.sqrt(n[k])) / alpha + L2))
    return w.astype(np.float32)


@dataclass
class Linear:
    """weights: (classes, 2 ** bits); rows: how many labelled rows it was trained on; features: what makes places of a text."""

    weights: object
    rows: int
    features: object = featurizer

    def scores(self, spark, text: Column) -> Column:
        """An array column: the logistic score of each class."""
        held, features = spark.sparkContext.broadcast(self.weights), self.features  # at most classes * 2 ** BITS * 4 bytes

        def work():
            import numpy as np
            import pyarrow as pa

            places, w = features(), np.ascontiguousarray(held.value.T)
            k = w.shape[1]

            def each(texts):
                out = np.empty((len(texts), k))
                for i, t in enumerate(texts):
                    at, x = places(t)
                    out[i] = x @ w[at]
                out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
                return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * k, pa.array(out.ravel()))

            return each

        return per_text(work, "array<double>")(text)


def trained(sample: DataFrame, classes: int = 1, bits: int = BITS, epochs: int = EPOCHS, features=featurizer, alpha: float = ALPHA, l1: float = L1) -> Linear:
    """Trains on sample(doc_id, text, y): y is 0 or 1 for one class, else the number of the class."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        places, rows = features(bits), []
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                target = np.array([float(y)]) if classes == 1 else (np.arange(classes) == y).astype(float)
                rows.append((*places(text), target))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([ftrl(rows, classes, bits, epochs, alpha, l1).tobytes()], pa.binary())], names=["n", "weights"])

    one = sample.select("text", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("by")).repartition(1).sortWithinPartitions("by")
    got = one.select("text", "y").mapInArrow(frugal(run), "n long, weights binary").collect()
    if not got:
        return Linear(np.zeros((classes, 1 << bits), np.float32), 0, features)
    return Linear(np.frombuffer(got[0]["weights"], np.float32).reshape(classes, 1 << bits), got[0]["n"], features)
