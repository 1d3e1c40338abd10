"""Toxicity by a learned lexicon whose trie is intersected with Levenshtein automata.

The lexicon comes from a bounded sample of labelled documents (`rows`, those of the smallest hash of
doc_id; near copies in the sample count once): whole words, and stems that take many endings, which occur
almost only in toxic documents; at most TERMS of them. A word of a text matches a term within 0 edits,
within 1 if the term has 5 letters or more, within 2 from 9 letters. All (trie node, edits) pairs that a
prefix of a word can be at form one state; states are made when first met, so a word costs one step a letter.

Each match is looked at in a window of WINDOW words on either side: quotation signs around it or a verb
of saying before it mark it as quoted, and quoted matches weigh less. The document score is logistic in
the counts of plain and quoted matches; its weights are fitted to the sample under a prior. A misspelled
match counts in part, by how often such matches of its term and distance were toxic in the sample.

Empty or null text: no match. Rows without doc_id are scored, never learned from. No labelled row: the
lexicon is empty and all scores are equal. Whole texts are read; extra columns are kept.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import WordIds, fold, labelled_sample, per_text

ROWS, TERMS, WINDOW = 9000, 500, 6
#: Verbs of saying before a quotation, and quotation signs.
SAYING = frozenset("said says wrote writes called calls quoted reported dit écrit appelle sagte schrieb nannte dijo dice escribió llamó".split())
QUOTES = "\"'“”„«»‘’`"
#: Signs around a word that are not part of it.
EDGES = ".,;:!?()[]{}<>|#%&$*+-=_~/\\…" + QUOTES
#: Prior of the score: constant, plain, quoted matches; and how strong it is.
PRIOR, STRENGTH = (-4.0, 6.0, 1.0), 0.05
#: What a misspelled match counts where the sample has none of its term, by edits.
TRUST = {1: 0.75, 2: 0.4}


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Which term of a lexicon a word is, and at what distance: the automaton of all terms, made as words need it.

    lexicon: term -> whether it is a stem (any ending may follow). A state is the set of (node, edits) pairs.
    """

    def __init__(self, lexicon: dict[str, bool]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [0]
        for t in sorted(lexicon):
            node = 0
            for c in t:
                node = self._child(node, c)
                self.room[node] = max(self.room[node], allowed(t))
            self.term[node] = t
        self.room[0] = max(self.room)
        self.stems = {t for t, stem in lexicon.items() if stem}
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []
        self.stem_seen: list[tuple | None] = []
        self.pairs: list[frozenset] = []
        self.start = self._state({0: 0})

    def _child(self, node, c):
        if c not in self.next[node]:
            self.next[node][c] = len(self.next)
            self.next.append({})
            self.term.append(None)
            self.room.append(0)
        return self.next[node][c]

    def _state(self, at: dict[int, int]) -> int:
        """Closes the pairs under letters of the term that the word lacks, and numbers the state."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at.get(node, 9) < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.room[child] and at.get(child, 9) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.pairs)
            self.pairs.append(key)
            self.steps.append({})
            done = [(e, self.term[n]) for n, e in key if self.term[n] and e <= allowed(self.term[n])]
            self.ends.append(min(done, default=None))
            self.stem_seen.append(min((x for x in done if x[1] in self.stems), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}

        def put(node, e):
            if e <= self.room[node] and at.get(node, 9) > e:
                at[node] = e

        for node, e in self.pairs[state]:
            put(node, e + 1)  # a letter that the term lacks
            for letter, child in self.next[node].items():
                put(child, e + (letter != c))
        found = self._state(at) if at else -1
        self.steps[state][c] = found
        return found

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the closest term, the first in order among equals; for stems, any beginning of the word counts."""
        if len(self.pairs) > 200_000:  # only so many states are kept
            self.states, self.steps, self.ends, self.stem_seen, self.pairs = {}, [], [], [], []
            self.start = self._state({0: 0})
        state, best = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return best
            stem = self.stem_seen[state]
            if stem and (best is None or stem < best):
                best = stem
        end = self.ends[state]
        return end if end and (best is None or end < best) else best


def quoted(words: list[str], i: int) -> bool:
    """Whether quotation signs enclose word i within the window, or a verb of saying is before it."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    opens = any(w[:1] in QUOTES for w in words[lo : i + 1] if w)
    closes = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[i:hi] if w.rstrip(".,;:!?"))
    return opens and closes or any(bare(w) in SAYING for w in words[lo:i])


def hits(text: str | None, found: WordIds) -> list[tuple[int, str, int, bool]]:
    """(word number, term, edits, quoted) of each match; found: word -> match of its bare form."""
    words = (text or "").split()
    return [(i, m[1], m[0], quoted(words, i)) for i, m in enumerate(map(found.__getitem__, words)) if m]


def lexicon_of(rows: list[tuple[str, int]]) -> dict[str, bool]:
    """term -> stem, from (text, toxic) rows: what occurs in at least 5 toxic documents and, smoothed, toxic in 9 of 10."""
    from collections import Counter

    words_in = [{b for w in text.split() if len(b := bare(w)) >= 3} for text, _ in rows]
    bad, all_, prefix_bad, prefix_all, endings = Counter(), Counter(), Counter(), Counter(), {}
    for ws, (_, y) in zip(words_in, rows, strict=True):
        ps = {w[:n] for w in ws for n in range(4, min(8, len(w)) + 1)}
        all_.update(ws)
        prefix_all.update(ps)
        if y:
            bad.update(ws)
            prefix_bad.update(ps)
            for w in ws:
                for n in range(4, min(8, len(w)) + 1):
                    endings.setdefault(w[:n], set()).add(w)
    good = lambda b, n: b >= 5 and (b + 0.5) / (n + 1) >= 0.9
    stems = {p for p, b in prefix_bad.items() if good(b, prefix_all[p]) and len(endings[p]) >= 4 and b >= 1.5 * max(bad[w] for w in endings[p])}
    stems = {p for p in stems if not any(p[:n] in stems for n in range(4, len(p)))}
    words = {w for w, b in bad.items() if good(b, all_[w]) and not any(w[:n] in stems for n in range(4, len(w) + 1))}
    ranked = sorted([(-prefix_bad[p], p, True) for p in stems] + [(-bad[w], w, False) for w in words])[:TERMS]
    return {t: stem for _, t, stem in ranked}


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without those that share two of their four smallest shingle hashes with an earlier row."""
    import xxhash

    seen, out = {}, []
    for text, y in rows:
        words = text.lower().split()
        marks = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))})[:4]
        shared = {}
        for m in marks:
            for r in seen.get(m, ()):
                shared[r] = shared.get(r, 0) + 1
        if any(n >= min(2, len(marks)) for n in shared.values()):
            continue
        for m in marks:
            seen.setdefault(m, []).append(len(out))
        out.append((text, y))
    return out


@dataclass
class Toxicity:
    lexicon: dict[str, bool] = field(default_factory=dict)
    trust: dict[tuple[str, int], float] = field(default_factory=dict)  # of a misspelled match, by term and edits
    weights: tuple = PRIOR

    def finder(self) -> WordIds:
        matcher = Matcher(self.lexicon)
        return WordIds(lambda w: matcher.match(bare(w)))

    def features(self, text: str | None, found: WordIds) -> list[float]:
        """Constant and saturating counts of plain and of quoted matches; a misspelled one counts as its trust."""
        n = [0.0, 0.0]
        for _, term, edits, in_quotes in hits(text, found):
            n[in_quotes] += self.trust.get((term, edits), TRUST[edits]) if edits else 1.0
        return [1.0, *(min(1.0, x) + 0.25 * math.log1p(x) for x in n)]

    def scores(self, spark, text: Column) -> Column:
        held = spark.sparkContext.broadcast(pickle.dumps((self.lexicon, self.trust, self.weights)))  # at most TERMS terms

        def work():
            import pyarrow as pa

            model = Toxicity(*pickle.loads(held.value))
            found = model.finder()

            def each(texts):
                out = []
                for t in texts:
                    z = sum(w * x for w, x in zip(model.weights, model.features(t, found), strict=True))
                    out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
                return pa.array(out, pa.float64())

            return each

        return per_text(work, "double")(text)


def learned(rows: list[tuple[str, int]]) -> Toxicity:
    """Lexicon, trust and weights from (text, toxic) rows."""
    import numpy as np

    rows = without_copies(rows)
    model = Toxicity(lexicon_of(rows))
    found = model.finder()
    seen: dict[tuple[str, int], list[int]] = {}
    for text, y in rows:
        marks = hits(text, found)
        if any(not e for _, _, e, _ in marks):
            continue  # toxic by an exact match already: says nothing of the misspelled ones
        for key in {(t, e) for _, t, e, _ in marks}:
            seen.setdefault(key, []).append(y)
    for key, ys in seen.items():
        model.trust[key] = max(0.0, 2 * (3 + sum(ys)) / (4 + len(ys)) - 1)
    x = np.array([model.features(t, found) for t, _ in rows]).reshape(-1, len(PRIOR))
    y = np.array([y for _, y in rows], float)
    w, prior = np.array(PRIOR), np.array(PRIOR)
    for _ in range(25):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + STRENGTH * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.weights = tuple(float(v) for v in w)
    return model


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Toxicity:
    """A model of labels.toxic from at most `rows` labelled documents outside the held-out fold (crc32 mod 5 = 0), learned in one task."""
    marked = labels.select("doc_id", F.col("toxic").alias("y"))
    sample = labelled_sample(docs, marked, rows, fold(5) != 0)

    def run(batches):
        import pyarrow as pa

        rows = [(t, int(y)) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)]
        if rows:
            m = learned(rows)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.lexicon, m.trust, m.weights))], pa.binary())], names=["model"])

    one = sample.select("text", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("by")).repartition(1).sortWithinPartitions("by")
    got = one.select("text", "y").mapInArrow(run, "model binary").collect()
    return Toxicity(*pickle.loads(got[0]["model"])) if got else Toxicity()


def toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs with a column filigree_score (0 to 1, higher is more toxic)."""
    return docs.withColumn("filigree_score", model.scores(docs.sparkSession, F.col("text")))
