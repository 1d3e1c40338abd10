"""Row-expanding operators: documents to chunks, text to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import ITEM_TITLES, paragraphs, words


def word_windows(docs: DataFrame, size: int = 500, overlap: int = 50, early_stop: bool = True) -> DataFrame:
    """(id, chunk, text): windows of size words, overlap shared. With early_stop the first window that reaches the end is the last."""
    step = max(1, size - overlap) if early_stop else size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.size("w")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)) if early_stop else F.ceil(n / step) - 1
    rows = docs.select("id", words(F.col("text")).alias("w")).where(n > 0)
    rows = rows.select("id", "w", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk"))
    return rows.select("id", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, size), " ").alias("text"))


def packed(lengths_of: Column, pieces: Column, most: int, carry: int, extra: int) -> Column:
    """Array of chunks (arrays of pieces): a piece that would take the sum of lengths beyond `most` begins a new chunk, which first takes the last `carry` pieces of the old one.

    extra counts for each piece added; state: chunks done, pieces of the open one, its length.
    """
    state = "struct<done:array<array<string>>,open:array<string>,len:int>"
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("len")).cast(state)

    def step(acc, p):
        size = F.length(p) + extra
        full = (F.size(acc["open"]) > 0) & (acc["len"] + size > most)
        kept = F.slice(acc["open"], F.greatest(F.size(acc["open"]) - carry + 1, F.lit(1)), carry) if carry else F.array().cast("array<string>")
        kept_len = F.aggregate(kept, F.lit(0), lambda a, x: a + F.length(x) + extra)
        fresh = F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.concat(kept, F.array(p)).alias("open"), (kept_len + size).alias("len")).cast(state)
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(p)).alias("open"), (acc["len"] + size).alias("len")).cast(state)
        return F.when(full, fresh).otherwise(grown)

    return F.aggregate(pieces, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def hard_split(paragraph: Column, most: int) -> Column:
    """Pieces of at most about `most` characters, cut between words; a longer word stays whole."""
    cut = F.transform(packed(paragraph, words(paragraph), most, 0, 1), lambda ws: F.array_join(ws, " "))
    return F.when(F.length(paragraph) > most, cut).otherwise(F.array(paragraph))


def section_chunks(docs: DataFrame, most: int = 1200, overlap: int = 1) -> DataFrame:
    """(id, chunk, text): paragraphs packed up to `most` characters (spaces between do not count), `overlap` pieces carried on; `prefix` leads each text."""
    pieces = F.flatten(F.transform(paragraphs(F.col("text")), lambda p: hard_split(p, most)))
    rows = docs.select("id", "prefix", F.posexplode(packed(None, pieces, most, overlap, 0)).alias("chunk", "ps"))
    return rows.select("id", "chunk", F.concat("prefix", F.array_join("ps", " ")).alias("text"))


def headings(texts: DataFrame) -> DataFrame:
    """(id, key, pos): every `Item N.` heading with its place in code points."""
    pattern = r"(?i)Item(?U:\s)+(\d{1,2}[A-C]?)(?U:\s)*\."
    pieces, found, keys = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    rows = texts.select("id", F.posexplode(F.arrays_zip(found.alias("m"), keys.alias("k"), F.slice(pieces, 1, F.size(found)).alias("gap"))).alias("i", "x"))
    run = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("x.gap") + F.length("x.m")).over(run) - F.length("x.m")
    return rows.select("id", F.upper("x.k").alias("key"), at.cast("int").alias("pos"))


def without_contents(rows: DataFrame, near: int = 2000, dense: int = 6) -> DataFrame:
    """Headings but those with `dense` or more different keys within `near` characters on either side: a table of contents."""
    around = Window.partitionBy("id").orderBy("pos").rangeBetween(-near, near)
    return rows.withColumn("keys", F.size(F.collect_set("key").over(around))).where(F.col("keys") < dense).drop("keys")


def longest_spans(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """For each key the heading with the longest stretch to the next one; the first of equals."""
    nxt = F.lead("pos").over(Window.partitionBy("id").orderBy("pos"))
    spans = rows.join(texts.select("id", F.length("text").alias("n")), "id").withColumn("span", F.coalesce(nxt, "n") - F.col("pos"))
    best = Window.partitionBy("id", "key").orderBy(F.desc("span"), "pos")
    return spans.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "key", "pos", "span")


def sections(texts: DataFrame, least: int = 400) -> DataFrame:
    """(id, item, title, start, end, n_chars, text): the text from each surviving heading to the next, if long enough and of a known item."""
    rows = longest_spans(without_contents(headings(texts)), texts)
    end = F.coalesce(F.lead("pos").over(Window.partitionBy("id").orderBy("pos")), F.length("text"))
    titles = F.create_map(*[F.lit(x) for pair in ITEM_TITLES.items() for x in pair])
    out = rows.join(texts, "id").withColumn("end", end).withColumn("body", F.trim(F.substr("text", F.col("pos") + 1, F.col("end") - F.col("pos"))))
    out = out.where((F.length("body") >= least) & titles[F.col("key")].isNotNull())
    return out.select("id", F.col("key").alias("item"), titles[F.col("key")].alias("title"), F.col("pos").alias("start"), "end", F.length("body").alias("n_chars"), F.col("body").alias("text"))


#: Where a key section begins, what it holds, where it ends; and the most signs of it.
KEY_SECTIONS = {
    "business": (r"(?is)(?:item\s+1[.\s]?business|business\s+overview)(.*?)(?:item\s+1a|risk\s+factors|end of item)", 10000),
    "risks": (r"(?is)(?:item\s+1a[.\s]?risk\s+factors|risk\s+factors)(.*?)(?:unresolved|financial|item\s+2|item\s+1b)", 10000),
    "md_and_a": (r"(?is)(?:item\s+7[.\s]?md&a|management.{0,50}discussion|md&a)(.*?)(?:item\s+8|financial\s+statements|consolidated\s+statements)", 15000),
}


def key_sections(text: Column) -> Column:
    """Struct business, risks, md_and_a: the stretch after each heading's first place, if over 100 characters, cut at its most."""
    body = lambda pattern: F.trim(F.regexp_extract(text, pattern, 1))
    return F.struct(*[F.when(F.length(body(p)) > 100, F.substring(body(p), 1, most)).alias(k) for k, (p, most) in KEY_SECTIONS.items()])
