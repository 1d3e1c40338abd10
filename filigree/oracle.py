"""The registered queries in SQL, for comparison."""

from __future__ import annotations

from filigree.functions.text import ITEM_TITLES, REFUSAL, REFUSAL_MARKS, STOPWORDS
from filigree.operators.filings import EVENT_LABELS
from filigree.queries import AS_OF, CONTENTS

STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"


def toks(t: str) -> str:
    """Search tokens of an expression."""
    raw = f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+(?:[-&][a-z0-9]+)*'), lambda t: NOT list_contains({STOP}, t))"
    parts = f"list_filter(regexp_split_to_array(t, '[-&]'), lambda p: p <> '' AND NOT list_contains({STOP}, p))"
    return f"flatten(list_transform({raw}, lambda t: CASE WHEN regexp_matches(t, '[-&]') THEN list_concat([t], {parts}) ELSE [t] END))"


def first_words(n: int) -> str:
    return rf"array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, {n}), ' ')"


BASE = f"""
p AS (SELECT doc_id AS ord, text, source AS ticker, lang AS item, {toks("coalesce(text, '')")} AS t FROM documents),
q AS (SELECT item_id AS qid, text AS question FROM benchmark),
sc AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN concat('src', CAST(qid % 20 AS VARCHAR)) END AS scope FROM q),
post AS (SELECT ord, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT ord, len(t) AS dl, unnest(t) AS term FROM p) GROUP BY ord, term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM p),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({toks("question")}) AS term FROM q) GROUP BY qid, term),
bm AS (SELECT qid, ord, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY qid, ord),
pt AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM p) GROUP BY ord, term),
pdf AS (SELECT term, ln(((SELECT count(*) FROM p) + 1) / (count(*) + 1)) + 1 AS idf FROM pt GROUP BY term),
pv AS (SELECT ord, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % 1024 AS b, sum((1 + ln(tf)) * idf) AS w FROM pt JOIN pdf USING (term) GROUP BY ord, b),
pn AS (SELECT ord, sqrt(sum(w * w)) AS len FROM pv GROUP BY ord),
qtt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q) GROUP BY qid, term),
qv AS (SELECT qid, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % 1024 AS b, sum((1 + ln(tf)) * coalesce(idf, 1)) AS w FROM qtt LEFT JOIN pdf USING (term) GROUP BY qid, b),
qn AS (SELECT qid, sqrt(sum(w * w)) AS len FROM qv GROUP BY qid),
tv AS (SELECT qid, ord, round(sum(qv.w / (qn.len + 1e-12) * pv.w / (pn.len + 1e-12)), 6) AS score FROM qv JOIN qn USING (qid) JOIN pv USING (b) JOIN pn USING (ord) GROUP BY qid, ord)
"""
LISTS = (
    BASE
    + """,
li AS (SELECT q.qid, p.ord, p.ticker, coalesce(bm.score, 0) AS bm25, coalesce(tv.score, 0) AS tfidf FROM q CROSS JOIN p LEFT JOIN bm ON bm.qid = q.qid AND bm.ord = p.ord LEFT JOIN tv ON tv.qid = q.qid AND tv.ord = p.ord),
rl AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, ord) - 1 AS INT) AS bm25_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY tfidf DESC, ord) - 1 AS INT) AS tfidf_rank FROM li),
fu AS (SELECT *, round(1 / (60 + bm25_rank + 1) + 1 / (60 + tfidf_rank + 1), 9) AS score FROM rl)
"""
)


def best(source: str, k: int, cols: str = "qid, ord, score", ties: str = "ord") -> str:
    return f"SELECT * FROM (SELECT {cols}, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, {ties}) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


NEAR = """
v AS (SELECT vec_id AS ord, embedding, label FROM embeddings),
s AS (SELECT a.ord AS qid, b.ord, a.label AS ql, b.label, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM v a, v b WHERE a.ord % 20 = 0),
n10 AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS INT) AS rank FROM s QUALIFY rank <= 10),
rel AS (SELECT label, list(ord ORDER BY ord) AS relevant FROM v GROUP BY label),
j AS (SELECT qid, any_value(ql) AS expected, list(ord ORDER BY rank) AS got, list(n10.label ORDER BY rank) AS labels FROM n10 GROUP BY qid),
g AS (SELECT j.*, relevant, list_transform(got, lambda x: CASE WHEN list_contains(relevant, x) THEN 1 ELSE 0 END) AS r FROM j JOIN rel ON rel.label = j.expected),
m AS (SELECT *, list_sum(r[1:1]) AS r1, list_sum(r[1:3]) AS r3, list_sum(r[1:5]) AS r5,
  (SELECT sum(CASE WHEN r[i] = 1 THEN 1 / log2(i + 1) ELSE 0 END) FROM range(1, 6) t(i)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(len(relevant), 5) + 1) t(i)) AS ndcg,
  len(list_filter(labels[1:5], lambda x: x = expected)) / 5 AS purity FROM g)
"""
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
PIECES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.:;])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')"


def greedy(source: str, most: int, extra: int, carry: bool, to: str) -> str:
    """CTEs over source (id, i, piece), i from 1: `to` (id, chunk, texts) packs pieces greedily.

    start: length before a piece. A piece that begins a chunk reaches as far as `most` allows from there, or from
    the piece before it where that is carried on; the recursion then steps from chunk to chunk.
    """
    back = "coalesce(lag(length(piece)) OVER (PARTITION BY id ORDER BY i), 0)" if carry else "0"
    first = "r.i - CASE WHEN r.chunk > 0 THEN 1 ELSE 0 END" if carry else "r.i"
    return f"""{to}_b AS (SELECT *, sum(length(piece) + {extra}) OVER (PARTITION BY id ORDER BY i) - length(piece) - {extra} AS start, {back} AS back FROM {source}),
{to}_e AS (SELECT id, i, CAST(start AS BIGINT) AS start, CAST(greatest({most} - back, 0) AS BIGINT) AS reach FROM {to}_b
  UNION ALL SELECT id, max(i) + 1, CAST(max(start + length(piece) + {extra}) AS BIGINT), 0 FROM {to}_b GROUP BY id),
{to}_n AS (SELECT id, i, i + greatest(1, count(*) OVER (PARTITION BY id ORDER BY start RANGE BETWEEN CURRENT ROW AND reach FOLLOWING) - 1) AS nxt, i = max(i) OVER (PARTITION BY id) AS ended FROM {to}_e),
{to}_r AS (SELECT id, 0 AS chunk, i, nxt FROM {to}_n WHERE i = 1 AND NOT ended
  UNION ALL SELECT g.id, r.chunk + 1, g.i, g.nxt FROM {to}_r r JOIN {to}_n g ON g.id = r.id AND g.i = r.nxt WHERE NOT g.ended),
{to} AS (SELECT r.id, r.chunk, list(piece ORDER BY p.i) AS texts FROM {to}_r r JOIN {source} p ON p.id = r.id AND p.i < r.nxt AND p.i >= {first} GROUP BY r.id, r.chunk)"""


def cut_pieces(rows: str, most: int) -> str:
    """CTEs over rows (id, para, text): hs (id, para, part, piece), where what is longer than `most` is cut between words."""
    return rf"""wo AS (SELECT (id, para) AS id, unnest(w) AS piece, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM {rows} WHERE length(text) > {most})),
{greedy("wo", most, 1, False, "wk")},
hs AS (SELECT id[1] AS id, id[2] AS para, chunk AS part, array_to_string(texts, ' ') AS piece FROM wk UNION ALL SELECT id, para, 0, text FROM {rows} WHERE length(text) <= {most})"""


PACKED = f"""
pa AS (SELECT doc_id AS id, unnest(p) AS text, unnest(range(0, len(p))) AS para FROM (SELECT doc_id, {PIECES} AS p FROM documents)),
{cut_pieces("pa", 1200)},
pk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY para, part) AS i, piece FROM hs),
{greedy("pk", 1200, 0, True, "ck")},
sk AS (SELECT id, CAST(chunk AS INT) AS chunk, source || ' 10-K - Item ' || lang || '. ' || array_to_string(texts, ' ') AS text FROM ck JOIN documents ON doc_id = id)"""


def mmr(k: int, weight: float) -> str:
    """CTEs over ca (qid, ord, score, rank): m1 to mk, the row each step of marginal relevance takes."""
    out = ["pr AS (SELECT a.qid, a.ord, b.ord AS taken, list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS near FROM ca a JOIN ca b USING (qid) JOIN v x ON x.ord = a.ord JOIN v y ON y.ord = b.ord)"]
    out.append("m1 AS (SELECT qid, ord, 1 AS place FROM ca QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) = 1)")
    out.append("t1 AS (FROM m1)")
    for i in range(2, k + 1):
        worst = f"(SELECT qid, ord, max(near) AS worst FROM pr JOIN (SELECT qid, ord AS taken FROM t{i - 1}) USING (qid, taken) GROUP BY qid, ord)"
        out.append(f"m{i} AS (SELECT qid, ord, {i} AS place FROM ca JOIN {worst} USING (qid, ord) WHERE (qid, ord) NOT IN (SELECT (qid, ord) FROM t{i - 1}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {weight}::DOUBLE * score - {round(1 - weight, 6)}::DOUBLE * worst DESC, rank) = 1)")
        out.append(f"t{i} AS (FROM t{i - 1} UNION ALL FROM m{i})")
    return ", ".join(out)


#: The stretch between two headings, as three lazy patterns.
LEGACY = {
    "business": (r"item\s+1[.\s]?business|business\s+overview", r"item\s+1a|risk\s+factors|end of item", 10000),
    "risks": (r"item\s+1a[.\s]?risk\s+factors|risk\s+factors", r"unresolved|financial|item\s+2|item\s+1b", 10000),
    "md_and_a": (r"item\s+7[.\s]?md&a|management.{0,50}discussion|md&a", r"item\s+8|financial\s+statements|consolidated\s+statements", 15000),
}


def legacy(opens: str, closes: str, most: int) -> str:
    body = f"length(trim(regexp_extract(text, '(?is)(?:{opens})(.*?)(?:{closes})', 1)))"
    return f"CASE WHEN {body} > 100 THEN CAST(least({body}, {most}) AS INT) ELSE 0 END"


def windows(early: bool) -> str:
    last = "CASE WHEN n <= 100 THEN 0 ELSE CAST(ceil((n - 100) / 90) AS INT) END" if early else "CAST(ceil(n / 90) AS INT) - 1"
    return f"""WITH w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), c AS (SELECT id, w, len(w) AS n FROM w WHERE len(w) > 0),
    x AS (SELECT id, w, CAST(unnest(range(0, {last} + 1)) AS INT) AS chunk FROM c),
    y AS (SELECT id, chunk, array_to_string(list_slice(w, chunk * 90 + 1, chunk * 90 + 100), ' ') AS text FROM x)
    SELECT id, chunk, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM y"""


ANSWERS = f"""
a AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role,
  CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN '{REFUSAL}' WHEN (conv_id * 1000 + turn) % 11 = 0 THEN text WHEN (conv_id * 1000 + turn) % 13 = 0 THEN '<your answer>'
  ELSE text || '. Revenue was $' || conv_id || ',5' || turn || '.2% [' || (turn % 5) || ']. Done [1].' END AS answer,
  text || ' ' || (conv_id - turn % 2) || '5' || turn || '.2' AS context FROM conversations)
"""


def nums(t: str) -> str:
    raw = rf"regexp_extract_all(regexp_replace({t}, '\[\d+\]', '', 'g'), '\d[\d,]*(?:\.\d+)?%?')"
    return f"list_transform({raw}, lambda x: rtrim(rtrim(replace(x, ',', ''), '%'), '.'))"


FEED = """
f0 AS (SELECT o_custkey AS ticker, o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN '/A' ELSE '' END AS form, CAST(o_orderdate AS DATE) AS date, o_orderkey AS key FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, key) AS pos FROM f0)
"""
FACTS = "fa AS (SELECT o_custkey AS ticker, o_orderstatus AS concept, CAST(year(o_orderdate) AS INT) AS e, round(sum(o_totalprice), 2) AS val FROM orders GROUP BY ALL)"
BARS = "b AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS ts, arg_max(value, (ts, event_id)) AS close, max(value) AS high, min(value) AS low, count(*) AS volume FROM events GROUP BY 1, 2)"
CALLS = "c AS (SELECT conv_id, turn, role || ':' || (length(text) % 3) AS call, length(text) % 4 = 0 AS failed FROM conversations)"
HITS = (
    BASE
    + f""",
ld AS (SELECT item_id AS qid, {first_words(8)} AS lead FROM benchmark),
tb AS ({best("bm", 5)}), tt AS ({best("tv", 5)}),
hs AS (SELECT 'bm25' AS config, q.qid, coalesce(max(CAST(contains(p.text, lead) AS INT)), 0) AS hit FROM q LEFT JOIN tb ON tb.qid = q.qid LEFT JOIN p ON p.ord = tb.ord LEFT JOIN ld ON ld.qid = q.qid GROUP BY q.qid
  UNION ALL SELECT 'tfidf', q.qid, coalesce(max(CAST(contains(p.text, lead) AS INT)), 0) FROM q LEFT JOIN tt ON tt.qid = q.qid LEFT JOIN p ON p.ord = tt.ord LEFT JOIN ld ON ld.qid = q.qid GROUP BY q.qid)
"""
)
RANKED = BASE + f", tb AS ({best('bm', 5)}), rh AS (SELECT tb.qid, tb.ord, rank, p.text, p.ticker, p.ticker || ' ' || p.item AS citation, greatest(1, CAST(floor(length(p.text) / 4) AS INT)) AS cost FROM tb JOIN p USING (ord)), bu AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM rh QUALIFY used <= 2000)"
ABSTAIN = BASE + f", t1 AS ({best('bm', 1)}), ab AS (SELECT q.qid, q.qid % 3 <> 0 AS answerable, CASE WHEN q.qid % 11 <> 0 THEN round(score / 20, 4) END AS score FROM q LEFT JOIN t1 USING (qid)), th AS (SELECT DISTINCT round(score, 2) AS threshold FROM ab WHERE score IS NOT NULL), cu AS (SELECT threshold, CAST(sum(CASE WHEN NOT answerable AND score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN answerable AND (score IS NULL OR score < threshold) THEN 1 ELSE 0 END) AS BIGINT) AS false_refusals FROM ab, th GROUP BY threshold), cv AS (SELECT *, missed * 5.0::DOUBLE + false_refusals AS cost FROM cu)"
HTML = "html"
for _a, _b in ((r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), ("<[^>]+>", " ")):
    HTML = f"regexp_replace({HTML}, '{_a}', '{_b}', 'g')"
for _a, _b in (("&nbsp;", " "), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
HTML = rf"trim(regexp_replace(replace(replace(replace(replace({HTML}, chr(160), ' '), '’', ''''), '“', '\"'), '”', '\"'), '\s+', ' ', 'g'))".replace('\\"', '"')
_BODY = r"regexp_replace(text, '\s+', ' ', 'g')"
MADE = "mf AS (SELECT doc_id AS id, '" + " ".join(f"Item {k}. Title" for k in CONTENTS) + "' || ' ' || repeat('filler ', 400)" + "".join(f" || ' Item {k}. ' || {_BODY} || ' ' || repeat('more ', 300)" for k in ("1", "1A", "7", "8")) + " AS text FROM documents WHERE text IS NOT NULL)"
HEADS = (
    MADE
    + r""",
hp AS (SELECT id, length(text) AS n, string_split(regexp_replace(text, '(?i)(Item\s+\d{1,2}[A-C]?\s*\.)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM mf),
hx AS (SELECT id, n, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM hp),
hy AS (SELECT id, n, i, piece, CAST(coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM hx),
hd AS (SELECT id, n, pos, upper(regexp_extract(piece, '(?i)^Item\s+(\d{1,2}[A-C]?)\s*\.', 1)) AS key FROM hy WHERE i > 1),
hk AS (SELECT a.id, a.n, a.pos, a.key FROM hd a JOIN hd b ON a.id = b.id AND b.pos BETWEEN a.pos - 2000 AND a.pos + 2000 GROUP BY ALL HAVING count(DISTINCT b.key) < 6)
"""
)
TITLES = "MAP {" + ", ".join(f"'{k}': '" + v.replace("'", "''") + "'" for k, v in ITEM_TITLES.items()) + "}"
EVENTS = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LABELS.items()) + " ELSE 'Corporate Event' END"


ORACLE = {
    "tokenize_stats": f"WITH {BASE} SELECT item, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS distinct_tokens, CAST(max(len(t)) AS INT) AS longest FROM p GROUP BY item",
    "tokenize_compounds": f"WITH {BASE}, x AS (SELECT unnest(t) AS term FROM p) SELECT term, count(*) AS n FROM x WHERE regexp_matches(term, '[-&]') GROUP BY term",
    "bm25_postings": f"WITH {BASE} SELECT ord, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, max(tf) AS max_tf, CAST(max(dl) AS INT) AS dl FROM post GROUP BY ord",
    "bm25_idf": f"WITH {BASE} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st",
    "bm25_topk": f"WITH {BASE} {best('bm', 5)}",
    "dense_topk": f"WITH {NEAR} {best('s', 5)}",
    "dense_scoped_topk": f"WITH {NEAR} {best('(SELECT * FROM s WHERE ql = label)', 5)}",
    "tfidf_sparse_topk": f"WITH {BASE} {best('tv', 5)}",
    "rank_lists": f"WITH {LISTS} SELECT qid, ord, bm25_rank, tfidf_rank FROM rl",
    "rrf_topk": f"WITH {LISTS} {best('fu', 5)}",
    "rrf_scoped_topk": f"WITH {LISTS}, so AS (SELECT fu.* FROM fu JOIN sc USING (qid) WHERE scope IS NULL OR ticker = scope) {best('so', 5, 'qid, ord, ticker, score')}",
    "ticker_resolve": """WITH a AS (SELECT conv_id * 1000 + turn AS qid, upper(role || ' ' || text) AS u FROM conversations),
      t AS (SELECT DISTINCT ticker FROM (SELECT upper(n_name) AS ticker FROM nation UNION ALL SELECT 'USER' UNION ALL SELECT 'ASK')),
      w AS (SELECT qid, min(ticker) AS ticker FROM a, t WHERE regexp_matches(u, '\\b' || ticker || '\\b') GROUP BY qid)
      SELECT a.qid, coalesce(w.ticker, CASE WHEN contains(u, 'ASSIST') THEN 'ASK' END) AS scope FROM a LEFT JOIN w USING (qid)""",
    "lexical_rerank_topk": f"""WITH {BASE}, c AS ({best('bm', 40)}), x AS (SELECT c.qid, c.ord, list_distinct({toks('question')}) AS qs, p.t FROM c JOIN q USING (qid) JOIN p USING (ord)),
      y AS (SELECT *, list_filter(list_transform(t, lambda w, i: CASE WHEN list_contains(qs, w) THEN i END), lambda i: i IS NOT NULL) AS pl FROM x),
      z AS (SELECT qid, ord, round(CASE WHEN len(qs) = 0 OR len(t) = 0 THEN 0 ELSE 0.75 * len(list_intersect(qs, t)) / len(qs) + 0.25 * CASE WHEN len(pl) >= 2 THEN 1 / (1 + (list_max(pl) - list_min(pl)) / len(t)) ELSE 0.5 END END, 6) AS score FROM y)
      {best('z', 5)}""",
    "retrieval_metrics": f"WITH {NEAR} SELECT " + ", ".join(f"round(avg(r{k} / len(relevant)), 6) AS recall_{k}, round(avg(CASE WHEN r{k} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5)) + ", round(avg(r5 / 5), 6) AS precision_5, round(avg(coalesce(1 / list_position(r, 1), 0)), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_5, round(avg(purity), 6) AS purity_5, count(*) AS n FROM m",
    "ndcg_per_query": f"WITH {NEAR} SELECT qid, round(ndcg, 6) AS ndcg FROM m",
    "purity": f"WITH {NEAR} SELECT qid, round(purity, 6) AS purity FROM m",
    "metrics_by_tag": f"WITH {NEAR}, x AS (SELECT unnest(['label' || expected, CASE WHEN qid % 40 = 0 THEN 'even' ELSE 'odd' END]) AS tag, CASE WHEN r5 > 0 THEN 1.0::DOUBLE ELSE 0 END AS h FROM m) SELECT tag, round(avg(h), 6) AS hit, count(*) AS n FROM x GROUP BY tag",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(list(value ORDER BY value)[least(CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT), count(*) - 1) + 1], 6) AS p95 FROM events GROUP BY event_type",
    "ablation_pivot": f"WITH {HITS} SELECT CAST(qid % 4 AS VARCHAR) AS tag, round(avg(hit) FILTER (config = 'bm25'), 6) AS bm25, round(avg(hit) FILTER (config = 'tfidf'), 6) AS tfidf FROM hs GROUP BY 1",
    "miss_set_ops": f"WITH {HITS}, a AS (SELECT qid FROM hs WHERE config = 'bm25' AND hit = 0), b AS (SELECT qid FROM hs WHERE config = 'tfidf' AND hit = 0) SELECT 'both' AS kind, qid FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'bm25_only', qid FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'tfidf_only', qid FROM (FROM b EXCEPT FROM a)",
    "label_validation": "SELECT doc_id * 2 AS doc_id, 'unknown document' AS problem FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id * 2) UNION ALL SELECT doc_id, 'lacks a fact' FROM labels JOIN documents USING (doc_id) WHERE NOT (contains(lower(text), 'the') AND contains(lower(text), ' the '))",
    "calibration_curve": f"WITH {ABSTAIN} SELECT * FROM cv",
    "calibration_choice": f"WITH {ABSTAIN} SELECT * FROM cv ORDER BY cost, false_refusals, threshold LIMIT 1",
    "word_window_chunks": windows(True),
    "legacy_chunks": windows(False),
    "paragraph_split": f"SELECT doc_id AS id, CAST(len({PIECES}) AS INT) AS n, CAST(coalesce(list_max(list_transform({PIECES}, lambda x: length(x))), 0) AS INT) AS longest, md5(array_to_string({PIECES}, '|')) AS digest FROM documents",
    "hard_split": rf"WITH RECURSIVE co AS (SELECT doc_id AS id, 0 AS para, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents), {cut_pieces('co', 300)} SELECT id, CAST(part AS INT) AS part, CAST(length(piece) AS INT) AS n_chars, md5(piece) AS digest FROM hs",
    "section_aware_chunks": f"WITH RECURSIVE {PACKED} SELECT id, chunk, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM sk",
    "chunk_stats": rf"""WITH RECURSIVE {PACKED},
      wn AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
      ww AS (SELECT w, unnest(range(0, CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450) AS INT) + 1 END)) AS c FROM wn WHERE len(w) > 0),
      al AS (SELECT 'word_window' AS strategy, length(array_to_string(w[c * 450 + 1 : c * 450 + 500], ' ')) AS n FROM ww UNION ALL SELECT 'section_aware', length(text) FROM sk)
      SELECT strategy, count(*) AS chunks, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean_chars, CAST(min(n) AS INT) AS min_chars, CAST(max(n) AS INT) AS max_chars FROM al GROUP BY strategy""",
    "legacy_sections": f"WITH {MADE}, lf AS (SELECT id, replace(replace(text, 'Item 1. ', 'Item 1. Business '), 'Item 1A. ', 'Item 1A. Risk Factors ') AS text FROM mf) SELECT id, {', '.join(f'{legacy(*x)} AS {k}' for k, x in LEGACY.items())} FROM lf",
    "mmr_select": f"WITH {NEAR.strip().rstrip(',')}, ca AS (SELECT qid, ord, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS INT) AS rank FROM s QUALIFY rank <= 40), {mmr(10, 0.7)} SELECT qid, ord, place FROM t10",
    "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
    "toc_density_filter": f"WITH {HEADS} SELECT f.id, found, coalesce(kept, 0) AS kept, first FROM (SELECT id, count(*) AS found FROM hd GROUP BY id) f LEFT JOIN (SELECT id, count(*) AS kept, min(pos) AS first FROM hk GROUP BY id) k USING (id)",
    "section_spans": f"""WITH {HEADS}, sp AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY id ORDER BY pos), n) - pos AS span FROM hk),
      ls AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY span DESC, pos) = 1),
      e AS (SELECT id, key, pos, CAST(coalesce(lead(pos) OVER (PARTITION BY id ORDER BY pos), n) AS INT) AS "end" FROM ls),
      b AS (SELECT e.*, CAST(length(trim(substr(text, pos + 1, "end" - pos))) AS INT) AS n_chars FROM e JOIN mf USING (id))
      SELECT id, key AS item, {TITLES}[key] AS title, pos AS start, "end", n_chars FROM b WHERE n_chars >= 400 AND {TITLES}[key] IS NOT NULL""",
    "context_budget": f"WITH {RANKED} SELECT qid, rank, ord, cost, used FROM bu",
    "context_assembly": f"WITH {RANKED}, x AS (SELECT qid, string_agg('[' || rank || '] (' || citation || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM bu GROUP BY qid) SELECT qid, CAST(length(c) AS INT) AS n_chars, md5(c) AS digest FROM x",
    "extractive_answers": rf"WITH {RANKED}, x AS (SELECT qid, string_agg(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) || ' [' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS c FROM bu WHERE rank <= 3 GROUP BY qid) SELECT q.qid, md5(coalesce(c, '{REFUSAL}')) AS digest FROM q LEFT JOIN x USING (qid)",
    "numeric_grounding": f"WITH {ANSWERS}, x AS (SELECT id, list_sort(list_filter(list_distinct({nums('answer')}), lambda x: NOT list_contains({nums('context')}, x))) AS u FROM a) SELECT id, array_to_string(u, ',') AS unsupported, len(u) = 0 AS ok FROM x",
    "citation_check": rf"""WITH {ANSWERS}, x AS (SELECT id, answer, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INT)), lambda m: m < 1 OR m > 3))) AS inv,
      list_filter(string_split(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM a),
      y AS (SELECT *, len(list_filter(ss, lambda s: regexp_matches(s, '\[\d+\]'))) AS n FROM x)
      SELECT id, array_to_string(inv, ',') AS invalid, round(n / greatest(len(ss), 1), 2) AS cited_share, len(inv) = 0 AND (n > 0 OR trim(answer) = '{REFUSAL}') AS ok FROM y""",
    "ticker_consistency": f"WITH {RANKED}, x AS (SELECT qid, list_sort(list_distinct(list(ticker))) AS t FROM rh GROUP BY qid) SELECT qid, array_to_string(t, ',') AS tickers, len(t) > 1 AS mixed, scope IS NULL OR t = [scope] AS ok FROM x JOIN sc USING (qid)",
    "refusal_flag": f"WITH {ANSWERS} SELECT id, " + " OR ".join("contains(lower(answer), '" + m.replace("'", "''") + "')" for m in REFUSAL_MARKS) + " AS refused FROM a",
    "must_include": "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'in') AS ok FROM documents",
    "filing_topn": f"WITH {FEED}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS r FROM f WHERE contains(form, '1-URGENT') OR contains(form, '2-HIGH')) SELECT ticker, form, date, key FROM x WHERE r <= 2",
    "event_feed": f"WITH {FEED}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS r, (key % 9) || '.0' || (key % 3) AS code FROM f WHERE form = '1-URGENT' AND date >= DATE '{AS_OF}' - 900) SELECT ticker, date, key, {EVENTS} AS event, CAST(DATE '{AS_OF}' - date AS INT) AS days_ago FROM x WHERE r <= 3",
    "take_while_recent": f"WITH {FEED}, x AS (SELECT *, sum(CASE WHEN date < DATE '{AS_OF}' - 900 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY pos) AS old, CAST(row_number() OVER (PARTITION BY ticker ORDER BY pos) AS INT) AS place FROM f WHERE form = '3-MEDIUM') SELECT ticker, date, key, place FROM x WHERE old = 0 AND place <= 5",
    "yoy_growth": f"WITH {FACTS}, x AS (SELECT *, lead(val) OVER w AS prev, row_number() OVER w AS r FROM fa WINDOW w AS (PARTITION BY ticker, concept ORDER BY e DESC)) SELECT ticker, concept, val AS value, e AS period, round((val - prev) / prev * 100, 2) AS yoy_growth FROM x WHERE r = 1",
    "concept_priority": f"WITH {FACTS}, x AS (SELECT ticker, concept, max(e) AS period, list_position(['P', 'F', 'O'], concept) AS k FROM fa GROUP BY ticker, concept) SELECT ticker, concept, period FROM x QUALIFY k = min(k) OVER (PARTITION BY ticker)",
    "sma_rolling": f"WITH {BARS} SELECT ticker, ts, " + ", ".join(f"round(CASE WHEN count(*) OVER w{n} = {n} THEN avg(close) OVER w{n} END, 6) AS sma{n}" for n in (5, 20)) + " FROM b WINDOW w5 AS (PARTITION BY ticker ORDER BY ts ROWS 4 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING)",
    "market_snapshot": f"WITH {BARS}, x AS (SELECT *, round(CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END, 6) AS sma5 FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 4 PRECEDING)) SELECT upper(ticker) AS ticker, round(close, 6) AS price, round(high, 6) AS day_high, round(low, 6) AS day_low, volume, sma5, CASE WHEN close > 30 AND close < 70 THEN 'neutral' ELSE 'extreme' END AS zone FROM x QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1",
    "latest_key": "SELECT event_type, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) AS INT) AS k, max(event_id) AS last_id FROM events GROUP BY event_type",
    "repeat_call_guard": f"WITH {CALLS} SELECT conv_id, turn, call, row_number() OVER (PARTITION BY conv_id, call ORDER BY turn) > 1 AS repeated FROM c",
    "error_budget": f"WITH {CALLS}, x AS (SELECT conv_id, turn, CAST(coalesce(sum(CAST(failed AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS errors_before FROM c) SELECT *, errors_before >= 1 AS stopped FROM x",
    "degenerate_answers": f"WITH {ANSWERS}, x AS (SELECT id, trim(answer) AS v, '(?i)<[a-z_ ]+>|TOOL_NAME_HERE|YOUR_ANSWER' AS r FROM a) SELECT id, length(v) < 15 OR NOT regexp_matches(v, '[A-Za-z]{{3}}') OR regexp_full_match(v, r) OR (length(v) < 60 AND regexp_matches(v, r)) AS degenerate FROM x",
    "truncate_output": "SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '...[truncated ' || (length(text) - 2000) || ' chars]' ELSE text END) AS digest FROM documents",
    "cik_lookup": "WITH s AS (SELECT 'n' || s_nationkey AS t, arg_min(s_suppkey, s_suppkey) AS k FROM supplier GROUP BY 1) SELECT c_custkey, lpad(CAST(k AS VARCHAR), 10, '0') AS cik FROM customer LEFT JOIN s ON t = 'n' || c_nationkey",
    "filing_urls": "SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '24' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/doc.htm' AS url FROM orders",
    "available_tickers": "SELECT source AS ticker, string_agg(DISTINCT lang, ',' ORDER BY lang) AS items FROM documents GROUP BY source",
}

_CHECKED = f"""ck AS (SELECT a.id, contains(lower(answer), 'the') AND contains(lower(answer), 'in') AS contains_required, contains(lower(context), 'the') AND contains(lower(context), 'in') AS context_contains,
  g.ok AS numeric_grounded, k.ok AS citations_ok, turn % 2 <> 0 OR turn % 3 <> 0 AS ticker_ok, a.id % 6 = 0 AS should_refuse, refused
  FROM a JOIN ({ORACLE['numeric_grounding']}) AS g USING (id) JOIN ({ORACLE['citation_check']}) AS k USING (id) JOIN ({ORACLE['refusal_flag']}) AS r USING (id)),
cp AS (SELECT *, CASE WHEN should_refuse THEN refused ELSE context_contains AND numeric_grounded AND citations_ok AND ticker_ok END AS passed FROM ck)"""


def _share(what: str, where: str = "") -> str:
    return f"round(avg(CASE WHEN {what} THEN 1.0::DOUBLE ELSE 0 END){where}, 3)"


_IN = " FILTER (NOT should_refuse)"
ORACLE |= {
    "answer_checks": f"WITH {ANSWERS}, {_CHECKED} SELECT id, contains_required, context_contains, numeric_grounded, citations_ok, ticker_ok, passed FROM cp",
    "generation_metrics": f"WITH {ANSWERS}, {_CHECKED} SELECT {_share('passed')} AS pass_rate, {_share('contains_required', _IN)} AS contains_required_rate, {_share('context_contains', _IN)} AS context_contains_rate, {_share('numeric_grounded', _IN)} AS numeric_grounded_rate, {_share('ticker_ok', _IN)} AS ticker_correct_rate, count(*) AS n FROM cp",
    "calibration_ranges": f"WITH {ABSTAIN}, s AS (SELECT answerable, coalesce(score, CAST('-inf' AS DOUBLE)) AS v FROM ab), e AS (SELECT min(v) FILTER (answerable) AS il, max(v) FILTER (answerable) AS ih, min(v) FILTER (NOT answerable) AS ol, max(v) FILTER (NOT answerable) AS oh FROM s) SELECT round(il, 3) AS in_low, round(ih, 3) AS in_high, round(ol, 3) AS out_low, round(oh, 3) AS out_high, coalesce(il > oh, true) AS separable, round(oh - il, 3) AS overlap FROM e",
    "earnings_filings": f"WITH {FEED}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS r FROM f WHERE form IN ('1-URGENT', '2-HIGH')) SELECT ticker, form, date, key, CASE form WHEN '1-URGENT' THEN 'quarterly' ELSE 'annual' END AS period FROM x WHERE r <= 2",
    "latest_report": f"WITH lf AS (SELECT source AS ticker, lang AS form, doc_id AS key, text FROM documents WHERE contains(lang, 'en') OR contains(lang, 'd') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1) SELECT ticker, form, key, CAST(length(text) AS INT) AS n_chars, {', '.join(f'{legacy(*x)} AS {k}' for k, x in LEGACY.items())} FROM lf WHERE text <> ''",
}
