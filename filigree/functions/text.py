"""Column functions over text: tokens, numbers, citations, HTML, chunk arithmetic. All run in the JVM."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "be", "by", "with", "as", "at", "that", "this", "from", "not", "it",
    "its", "our", "we", "their", "which", "what", "how", "much", "many", "do", "does", "did", "was", "were", "has", "have", "had", "will", "would",
    "can", "could", "i", "you",
]
#: Section titles by item.
ITEM_TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties",
    "3": "Legal Proceedings", "5": "Market for Registrant's Common Equity", "7": "Management's Discussion and Analysis",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk", "8": "Financial Statements and Supplementary Data",
    "9A": "Controls and Procedures",
}
#: Fixed value: the sentence that stands for a refusal.
REFUSAL = "I could not find this in the filings provided."
#: What marks an answer as a refusal.
REFUSAL_MARKS = ["could not find", "not in the filings", "cannot answer", "no information", "unable to determine", "don't have"]
#: Fixed value: what a model echoes in place of an answer.
PLACEHOLDER = "(?i)<[a-z_ ]+>|TOOL_NAME_HERE|YOUR_ANSWER"
#: An answer without content is shorter than LEAST signs, or shorter than SHORT with a placeholder in it.
LEAST, SHORT = 15, 60
#: What is a token of the embedder, a search token, a figure.
PLAIN_TOKEN, TOKEN, FIGURE = "[a-z0-9]+", "[a-z0-9]+(?:[-&][a-z0-9]+)*", r"\d[\d,]*(?:\.\d+)?%?"


def words(text: Column) -> Column:
    """Runs without white space (Unicode spaces split too); no empty strings."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_tokens(text: Column) -> Column:
    """The embedder's tokens: ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Search tokens: alphanumeric runs with inner - and & kept, then their parts after each compound; stop words out; repeats stay."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    kept = F.filter(raw, lambda t: ~t.isin(STOPWORDS))
    parts = lambda t: F.filter(F.split(t, "[-&]"), lambda p: (p != "") & ~p.isin(STOPWORDS))
    return F.flatten(F.transform(kept, lambda t: F.when(t.rlike("[-&]"), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags become spaces, the entities of web pages are decoded (&amp; last), quotes straightened, white space collapsed.

    Entities beyond these five and numeric ones are decoded by unescaped(), which needs Python.
    """
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return collapsed(F.translate(out, "\u00a0’“”", " '\"\""))


def unescaped(html: Column) -> Column:
    """html_to_text with every named and numeric entity: an Arrow function, as no built-in decodes them."""
    def decode(part: pa.Array) -> pa.Array:
        from html import unescape

        return pa.array([None if t is None else unescape(t) for t in part.to_pylist()], pa.string())

    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.arrow_udf(decode, "string")(F.regexp_replace(out, "<[^>]+>", " "))
    return collapsed(F.translate(out, "\u00a0’“”", " '\"\""))


def numbers(text: Column) -> Column:
    """Figures without commas, percent sign or trailing point; citation marks do not count."""
    raw = F.regexp_extract_all(F.regexp_replace(text, r"\[\d+\]", ""), F.lit(FIGURE), F.lit(0))
    return F.transform(raw, lambda n: F.rtrim(F.rtrim(F.replace(n, F.lit(","), F.lit("")), F.lit("%")), F.lit(".")))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(numbers(answer)), numbers(context)))


def cited(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def citation_check(answer: Column, n_sources: Column) -> Column:
    """Struct: invalid marks, share of sentences with a mark (2 digits), ok."""
    marks, parts = cited(answer), sentences(answer)
    invalid = F.array_sort(F.array_distinct(F.filter(marks, lambda m: (m < 1) | (m > n_sources))))
    with_mark = F.size(F.filter(parts, lambda s: s.rlike(r"\[\d+\]")))
    share = F.round(with_mark / F.greatest(F.size(parts), F.lit(1)), 2)
    ok = (F.size(invalid) == 0) & ((with_mark > 0) | (F.trim(answer) == REFUSAL))
    return F.struct(invalid.alias("invalid"), share.alias("cited_share"), ok.alias("ok"))


def is_refusal(answer: Column) -> Column:
    low, out = F.lower(answer), F.lit(False)
    for mark in REFUSAL_MARKS:
        out = out | F.contains(low, F.lit(mark))
    return out


def is_degenerate(answer: Column) -> Column:
    v = F.trim(answer)
    whole = v.rlike(f"^(?:{PLACEHOLDER})$")
    return (F.length(v) < LEAST) | ~v.rlike("[A-Za-z]{3}") | whole | ((F.length(v) < SHORT) & v.rlike(PLACEHOLDER))


def truncated(text: Column, most: int = 6000) -> Column:
    """The first `most` characters and a note of how many are gone."""
    gone = F.length(text) - most
    return F.when(gone > 0, F.concat(F.substring(text, 1, most), F.lit("\n...[truncated "), gone.cast("string"), F.lit(" chars]"))).otherwise(text)


def all_included(text: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: F.contains(F.lower(text), F.lower(n)))


def paragraphs(text: Column) -> Column:
    """Pieces between a full stop, colon or semicolon and a capital or bracket."""
    return F.filter(F.transform(F.split(text, r"(?<=[.:;])\s+(?=[A-Z(])"), lambda p: F.trim(p)), lambda p: p != "")


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)
