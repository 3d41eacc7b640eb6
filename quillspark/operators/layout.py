"""From layout blocks to sections: recurring lines, headings, sections, abstracts; and Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import clean_paragraph, stripped

# Limits of headings, and words that no heading ends with.
HEADING_RATIO, HEADING_MAX_WORDS, HEADING_MIN_CHARS, HEADING_MAX_CHARS = 1.30, 12, 4, 90
HEADING_NOT_LAST = ("and", "or", "the", "a", "an", "of", "to", "in", "for", "with", "by", "from", "on", "at")
MATH_SIGNS = "=≈≤≥∈∉∧∨∑∏∫√±·×÷⊆⊇⊂⊃∀∃∞→←↔⇒⇐⇔"
MIN_CHARS_PER_PAGE = 100
ABSTRACT_STOP, ABSTRACT_CHARS = 2500, 2000


def recurring_lines(lines: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, text, n_pages): lines of 3 to 120 characters, not ending with a dot, on at least max(3, 40 %) of a document's pages, of at least 4.

    Lines count, and come back, without white space at their ends.
    """
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages")).filter("pages >= 4")
    own = lines.select(doc, page, stripped(text).alias(text))
    short = own.filter((F.length(text) >= 3) & (F.length(text) <= 120) & ~F.endswith(F.col(text), F.lit(".")))
    counted = short.groupBy(doc, text).agg(F.countDistinct(page).alias("n_pages"))
    return counted.join(pages, doc).filter(F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.4))).drop("pages")


def strip_recurring(lines: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """lines without the recurring ones, whatever white space stands at their ends."""
    found = recurring_lines(lines, doc, page, text).select(F.col(doc).alias("_doc"), F.col(text).alias("_line"))
    return lines.join(found, (F.col(doc) == F.col("_doc")) & (stripped(text) == F.col("_line")), "left_anti")


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


# What no heading looks like, and the numbers before numbered ones.
BANNER, ADDRESS, NUMBERING = r"(?i)^\s*arxiv\s*:\s*\d", r"(?i)https?://|doi\.org|github\.com|@\S+\.\S+", r"^\d+(\.\d+)*\.?\s+"


def is_heading(text: Column, font_size: Column, body_size: Column) -> Column:
    """Whether a block is a heading: numbered or in a larger font, short, wordy, and not cut off."""
    t = F.trim(text)
    rejected = (
        (t == "") | t.rlike(BANNER) | t.rlike(ADDRESS) | t.rlike(r"(?U)^[\d\W]+$")
        | t.rlike(f"[{MATH_SIGNS}]") | (_letters(t) < 3) | (F.length(F.regexp_replace(t, r"[\p{L}\s]", "")) / F.greatest(F.length(t), F.lit(1)) > 0.40)
    )
    numbered = t.rlike(NUMBERING + r"\S")
    bare = numbered & (_letters(F.regexp_replace(t, NUMBERING, "")) < 3)
    words = F.split(t, r"\s+", -1)
    cut_off = ~numbered & t.rlike(r"[-,;:.]$")
    long = (F.length(t) > HEADING_MAX_CHARS) | (F.length(t) < HEADING_MIN_CHARS)
    found = ~rejected & ~bare & (numbered | (font_size >= body_size * HEADING_RATIO)) & (F.size(words) <= HEADING_MAX_WORDS) & ~cut_off & ~F.lower(F.element_at(words, -1)).isin(*HEADING_NOT_LAST)
    # Most blocks are too long, and patterns over all of their text would take most of the time.
    return F.when(long, F.lit(False)).otherwise(found)


def with_headings(blocks: DataFrame, doc: str = "paper_id") -> DataFrame:
    """blocks(paper_id, ord, text, font_size, page, ...) with is_heading; the body size is the document's median size.

    Blocks come sorted by document and ord, for windows that follow.
    """
    body = F.coalesce(F.median("font_size").over(Window.partitionBy(doc)), F.lit(10.0))
    # One sort serves this window and the next.
    return blocks.repartition(doc).sortWithinPartitions(doc, "ord").withColumn("_body", body).withColumn("is_heading", is_heading(F.col("text"), F.col("font_size"), F.col("_body"))).drop("_body")


def sections(blocks: DataFrame, doc: str = "paper_id") -> DataFrame:
    """(paper_id, section_no, heading, body): a heading opens a section; the text before the first is section 0."""
    marked = with_headings(blocks, doc).withColumn("section_no", F.sum(F.col("is_heading").cast("long")).over(Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("ord", "text")))), lambda p: p["text"])
    grouped = marked.groupBy(doc, "section_no").agg(F.coalesce(F.max(F.when(F.col("is_heading"), F.col("text"))), F.lit("")).alias("heading"), F.array_join(parts, " ").alias("raw"))
    return grouped.select(doc, "section_no", "heading", clean_paragraph("raw").alias("body")).filter((F.col("heading") != "") | (F.col("body") != ""))


def abstracts(found: DataFrame, doc: str = "paper_id") -> DataFrame:
    """(paper_id, abstract): the text under the last heading that begins with "abstract", cleaned and cut."""
    own = found.filter(F.col("heading").rlike(r"(?i)^\s*abstract\b"))
    return own.groupBy(doc).agg(F.substring(F.max_by("body", "section_no"), 1, ABSTRACT_CHARS).alias("abstract"))


def markdown(found: DataFrame, doc: str = "paper_id") -> DataFrame:
    """(paper_id, md) of sections."""
    piece = F.concat_ws("\n\n", F.when(F.col("heading") != "", F.concat(F.lit("## "), F.col("heading"))), F.when(F.col("body") != "", F.col("body")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", piece.alias("p")))), lambda p: p["p"]), "\n\n")
    return found.groupBy(doc).agg(F.concat(whole, F.lit("\n")).alias("md"))


def needs_ocr(n_chars: Column, n_pages: Column) -> Column:
    return n_chars / F.greatest(n_pages, F.lit(1)) < MIN_CHARS_PER_PAGE


def split_sections(md: Column) -> Column:
    """array<struct<heading, body>> of Markdown: text before the first ## heading has heading ''; empty bodies are left out."""
    heading = r"^##\s+(.+)"
    parts = F.split(md, r"(?m)^(?=##\s+\S)", -1)
    made = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, heading, 1)).alias("heading"), F.btrim(F.when(p.rlike(heading), F.regexp_replace(p, r"^##\s+.+(\n|$)", "")).otherwise(p), F.lit(" \t\n\r")).alias("body")))
    return F.filter(made, lambda s: s["body"] != "")


def pick_sections(md: Column, wanted: list[str]) -> Column:
    """The Markdown of the sections whose heading holds one of the wanted words, without case; all of it if none are given."""
    if not wanted:
        return md
    holds = lambda s: F.exists(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.contains(F.lower(s["heading"]), w))
    kept = F.filter(split_sections(md), lambda s: (s["heading"] != "") & holds(s))
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["body"])), "\n\n")
