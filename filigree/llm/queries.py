"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import decontaminate, language, lines, media, mixing, pii, quality, sharding, simhash, toxicity
from filigree.llm.common import fold, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    base = F.filter("found", lambda x: x["base"])
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs.select("doc_id", "text"), quality.fitted(docs, table(spark, sf_dir, "labels")))
    score = F.col("filigree_score")
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.array_join("near", ",").alias("near_items"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs.select("doc_id", "text"), toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    score = F.col("filigree_score")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("filigree_lines").alias("n_lines"), F.col("filigree_removed").alias("n_removed"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language.identified(docs.select("doc_id", "text"), language.fitted(docs, fold(4) != 2))
    found = F.col("filigree_lang")
    return named.select("doc_id", (fold(4) == 2).alias("held_out"), found["lang"].alias("lang_pred"), found["score"].alias("score"), found["rejected"].alias("rejected"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_media, op3_sharding, op4_mixing, op5_pii, op6_quality, op7_decontaminate, op8_toxicity, op9_lines, op10_language)}

#: Words of an expression as op7 takes them.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, w, least({decontaminate.SIZE}, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM b, unnest(range(1, len(w) - n + 2)) AS t(p)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
o AS (SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM g) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
m AS (SELECT k, item_id, p, n FROM o JOIN g USING (n, gram)),
h AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS place FROM m) GROUP BY k),
f AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k),
t AS (SELECT k, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p) WHERE w[p] IN (SELECT unnest(w) FROM b)),
c AS (SELECT word, count(*) AS n FROM t GROUP BY word),
v AS (SELECT row_number() OVER () AS v, * FROM (SELECT DISTINCT item_id, n, w[p : p + n - 1] AS w FROM b, unnest(range(1, len(w) - n + 2)) AS t(p))),
l AS (SELECT v, x.n, item_id, j, word, row_number() OVER (PARTITION BY v ORDER BY coalesce(c.n, 0), encode(word), j) AS r FROM (SELECT v, n, item_id, j, w[j] AS word FROM v, unnest(range(1, n + 1)) AS t(j)) AS x LEFT JOIN c USING (word)),
q AS (SELECT a.v, a.n, a.item_id, t.k, t.p - a.j AS d FROM l AS a JOIN t USING (word) WHERE a.r = 1),
q2 AS (SELECT DISTINCT q.* FROM q JOIN l AS b ON b.v = q.v AND b.r = least(2, q.n) JOIN t ON t.k = q.k AND t.word = b.word AND abs(t.p - b.j - q.d) <= {decontaminate.SLACK}),
y AS (SELECT q2.v, q2.n, q2.item_id, q2.k, q2.d FROM q2 JOIN l ON l.v = q2.v JOIN t ON t.k = q2.k AND t.word = l.word AND abs(t.p - l.j - q2.d) <= {decontaminate.SLACK} GROUP BY ALL HAVING count(DISTINCT l.j) >= q2.n - q2.n // 6),
z AS (SELECT k, string_agg(item_id, ',' ORDER BY item_id) AS near FROM (SELECT DISTINCT k, item_id FROM y) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near, '') AS near_items
FROM d LEFT JOIN h USING (k) LEFT JOIN f USING (k) LEFT JOIN z USING (k)
"""

#: Runs of every length. Different texts of one doc_id, which no table here has, come in the order of their text.
OP9_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_transform(l, lambda x: len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+'))) AS n FROM d),
r AS (SELECT doc_id, text, size, p, md5(array_to_string(l[p : p + size - 1], chr(10))) AS run FROM w, unnest(range(1, len(l) + 1)) AS a(p), unnest(range(1, len(l) - p + 2)) AS b(size) WHERE list_sum(n[p : p + size - 1]) >= 20),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY size, run ORDER BY doc_id NULLS LAST, text, p) > 1),
g AS (SELECT doc_id, text, list(DISTINCT place) AS gone FROM (SELECT doc_id, text, unnest(range(p, p + size)) AS place FROM c) GROUP BY doc_id, text)
SELECT a.doc_id, CASE WHEN gone IS NULL THEN a.text ELSE array_to_string(list_filter(string_split(a.text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text,
       CAST(coalesce(len(string_split(a.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM documents a LEFT JOIN g ON a.doc_id IS NOT DISTINCT FROM g.doc_id AND a.text = g.text
"""

#: XXH64, JPEG coding, trained models and label propagation have no SQL form.
ORACLE: dict[str, str] = {"op7_decontaminate": OP7_SQL, "op9_lines": OP9_SQL}
