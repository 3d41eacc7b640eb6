"""Chunks of a token budget, with overlap, from Markdown."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import count_tokens, padded
from quillspark.functions.workers import bound_batches, ship_package
from quillspark.operators.layout import split_sections

# Budget and overlap of a chunk, and what a chunk must have to be kept.
CHUNK_TOKENS, CHUNK_OVERLAP, MIN_TOKENS, MIN_ALPHA, MIN_CHARS = 768, 96, 40, 0.55, 200
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\[])")


def useful(text: Column | str, tokens: Column | None = None) -> Column:
    """The quality filter of chunks: long enough, mostly letters, enough tokens."""
    t = F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\r"))
    n = F.length(t)
    return (n >= MIN_CHARS) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(n, F.lit(1)) >= MIN_ALPHA) & ((count_tokens(t) if tokens is None else tokens) >= MIN_TOKENS)


def white_space_tokens(text: str) -> list[str]:
    return text.split()


def pack_units(text: str, budget: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, tokenize: Callable[[str], list[str]] = white_space_tokens, glue: str = " ") -> list[str]:
    """Chunks of whole paragraphs, or of sentences of longer ones, that begin with what ends the chunk before.

    A paragraph over budget without sentence ends is cut into windows of tokens; a longer sentence stays whole.
    """
    units: list[tuple[str, int]] = []
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        words = tokenize(paragraph)
        if len(words) <= budget:
            units.append((paragraph, len(words)))
        elif len(parts := _SENTENCE.split(paragraph)) > 1:
            units += [(s, len(tokenize(s))) for s in parts]
        else:
            units += [(glue.join(w := words[a : a + budget]), len(w)) for a in range(0, len(words), budget - overlap)]
    out: list[str] = []
    first, total = 0, 0
    for at, (_, size) in enumerate(units):
        if first < at and total + size > budget:
            out.append("\n\n".join(u for u, _ in units[first:at]))
            kept, total = at, 0
            while kept > first and total + units[kept - 1][1] <= overlap:
                kept -= 1
                total += units[kept][1]
            first = kept
        total += size
    if units:
        out.append("\n\n".join(u for u, _ in units[first:]))
    return out


def chunk_sections(docs: DataFrame, key: str = "paper_id", md: str = "md", budget: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, tokenize: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(key, chunk_id, idx, section, text, tokens) of docs(key, md): sections within the budget whole, others packed; useful chunks only.

    tokenize cuts a text into the tokens by which budgets are counted, white space included (a byte-pair encoding's, for example);
    without it tokens are words between white space, sections are split and short ones passed through in the JVM, and
    only sections over budget go to Python, in batches of few rows and bytes: a worker holds one batch, or one longer section.
    """
    bound_batches(docs.sparkSession)
    ship_package(docs.sparkSession)
    parts = docs.select(key, F.posexplode(split_sections(F.col(md))).alias("section_no", "s")).select(key, "section_no", F.col("s.heading").alias("section"), F.col("s.body").alias("body"))

    @F.pandas_udf("array<string>")
    def packed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: pack_units(b, budget, overlap, tokenize or white_space_tokens, " " if tokenize is None else ""))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenize(t or "")))

    # Of what is exploded Spark first filters the empty, which would pack each section twice, in two workers a task.
    packed = packed.asNondeterministic()
    count = count_tokens if tokenize is None else lambda c: counted(F.col(c))
    parts = parts.withColumn("size", count("body"))
    fits = F.col("size") <= budget
    whole = parts.filter(fits).withColumn("pieces", F.array("body"))
    long = parts.filter(~fits).withColumn("pieces", packed("body"))
    pieces = whole.unionByName(long).select(key, "section_no", "section", F.posexplode("pieces").alias("piece", "text")).withColumn("text", F.btrim("text", F.lit(" \t\n\r")))
    kept = pieces.withColumn("tokens", count("text")).filter(useful("text", F.col("tokens")))
    numbered = kept.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("section_no", "piece")) - 1)
    return numbered.select(key, F.concat(F.col(key), F.lit("::"), padded("idx", 4)).alias("chunk_id"), "idx", "section", "text", "tokens")
