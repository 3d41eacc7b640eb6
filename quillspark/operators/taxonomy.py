"""Rule-based topics, platforms and domains. Rules are data: rules(ord, pattern, label) with Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Unicode classes, case-insensitive as Python's expressions are, and line ends as in Python.
_FLAGS = "(?iuUd)"
HEAD_CHARS = 8192
UNCATEGORIZED = "uncategorized"


#: Rules are evaluated in each row, as literals; more than this would make a plan too large.
MOST_RULES = 5_000


def _literals(rules: DataFrame) -> list:
    """The rows of a table of rules, in their order."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(rows)


def _hits(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(_FLAGS + pattern))


def _labels(rules: DataFrame, holds) -> Column:
    """The labels of the rules(ord, pattern, label) that hold, each once, in the order of the rules; no join, no shuffle."""
    own = [F.when(holds(r["pattern"]), F.lit(r["label"])) for r in _literals(rules.select("ord", "pattern", "label"))]
    return F.array_distinct(F.array_compact(F.array(*own))) if own else F.array().cast("array<string>")


def topics(docs: DataFrame, rules: DataFrame, key: str = "id", title: str = "title", abstract: str = "abstract", body: str = "body") -> DataFrame:
    """(key, topics): a rule holds with a hit in title and abstract, or two in the head of the body."""
    texts = docs.select(key, F.concat_ws("\n\n", title, abstract).alias("_front"), F.coalesce(F.substring(body, 1, HEAD_CHARS), F.lit("")).alias("_head"))
    found = texts.select(key, _labels(rules, lambda p: (_hits("_front", p) >= 1) | (_hits("_head", p) >= 2)).alias("labels"))
    return found.select(key, F.when(F.size("labels") == 0, F.array(F.lit(UNCATEGORIZED))).otherwise(F.col("labels")).alias("topics"))


def platforms(docs: DataFrame, rules: DataFrame, key: str = "id", title: str = "title", abstract: str = "abstract", body: str = "body") -> DataFrame:
    """(key, platforms): a rule holds with a hit anywhere in title, abstract and the head of the body."""
    texts = docs.select(key, F.concat_ws("\n", title, abstract, F.substring(body, 1, HEAD_CHARS)).alias("_all"))
    return texts.select(key, _labels(rules, lambda p: _hits("_all", p) >= 1).alias("platforms"))


def domains(docs: DataFrame, mapping: DataFrame, key: str = "id", categories: str = "categories") -> DataFrame:
    """(key, domains): the domains of a paper's categories by mapping(category, domain), each once, as they come first."""
    parts = docs.select(key, F.posexplode_outer(categories).alias("pos", "category")).join(mapping, "category", "left")
    first = parts.groupBy(key, "domain").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("pos", "domain"))))
    return first.groupBy(key).agg(F.transform(ordered, lambda x: x["domain"]).alias("domains"))


def facet_counts(rows: DataFrame, facet: str) -> DataFrame:
    """(facet, count) of an array column."""
    return rows.select(F.explode(facet).alias("facet")).groupBy("facet").agg(F.count("*").alias("count"))


def coverage_gaps(papers: DataFrame, pairs: DataFrame, key: str = "id", title: str = "title", facet: str = "topics", samples: int = 8) -> DataFrame:
    """(word, label, missing, examples): titles that hold a word of pairs(word, label) without the label; the first
    `samples` titles by key, cut to 80 characters."""
    low = F.lower(F.col(title))
    gaps = [F.when(F.contains(low, F.lit(r["word"].lower())) & ~F.array_contains(facet, r["label"]), F.struct(F.lit(r["word"]).alias("word"), F.lit(r["label"]).alias("label"))) for r in _literals(pairs.select("word", "label"))]
    if not gaps:
        return papers.sparkSession.createDataFrame([], "word string, label string, missing long, examples array<string>")
    found = papers.select(F.col(key).alias("key"), F.substring(title, 1, 80).alias("title"), F.explode(F.array_compact(F.array(*gaps))).alias("g")).select("g.word", "g.label", "key", "title")
    counts = found.groupBy("word", "label").agg(F.count("*").alias("missing"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("word", "label").orderBy("key", "title"))).filter(F.col("n") <= samples)
    listed = first.groupBy("word", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("examples"))
    return counts.join(listed, ["word", "label"]).select("word", "label", "missing", "examples")
