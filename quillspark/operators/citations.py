"""Citation graph: identifiers mentioned in full texts, resolved against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import arxiv_ids, dois, own_arxiv_id


def mentions(texts: DataFrame, key: str = "paper_id", md: str = "md") -> DataFrame:
    """(paper_id, kind, ref, times): identifiers that a text mentions, and how often."""
    found = texts.select(F.col(key).alias("paper_id"), F.explode(F.concat(F.transform(arxiv_ids(md), lambda i: F.struct(F.lit("arxiv").alias("kind"), i.alias("ref"))), F.transform(dois(md), lambda d: F.struct(F.lit("doi").alias("kind"), d.alias("ref"))))).alias("m"))
    return found.groupBy("paper_id", "m.kind", "m.ref").agg(F.count("*").alias("times"))


def own_ids(papers: DataFrame, key: str = "paper_id", url: str = "pdf_url", order: str | None = None) -> DataFrame:
    """(kind, ref, owner): the identifiers anywhere in a paper's own URL; of several owners, the last by `order` (by key without one)."""
    doi = F.get(dois(url), F.lit(0))
    ids = papers.select(F.col(key).alias("owner"), F.col(order or key).alias("place"), F.explode(F.array_compact(F.array(F.when(own_arxiv_id(url).isNotNull(), F.struct(F.lit("arxiv").alias("kind"), own_arxiv_id(url).alias("ref"))), F.when(doi.isNotNull(), F.struct(F.lit("doi").alias("kind"), doi.alias("ref")))))).alias("m"))
    return ids.groupBy("m.kind", "m.ref").agg(F.max_by("owner", F.struct("place", "owner")).alias("owner"))


def paper_refs(found: DataFrame, own: DataFrame) -> DataFrame:
    """(paper_id, kind, ref): what each paper refers to, without its own arXiv id."""
    self_made = own.filter("kind = 'arxiv'").select(F.col("owner").alias("paper_id"), "kind", "ref")
    return found.select("paper_id", "kind", "ref").join(self_made, ["paper_id", "kind", "ref"], "left_anti")


def edges(found: DataFrame, own: DataFrame) -> DataFrame:
    """(src, dst, kind, times): mentions of papers of the corpus, without those of a paper by itself."""
    return found.join(own, ["kind", "ref"]).filter("owner != paper_id").groupBy(F.col("paper_id").alias("src"), F.col("owner").alias("dst"), "kind").agg(F.sum("times").alias("times"))


def cites(graph: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(paper, other, title, n): what each paper cites, kinds together."""
    return graph.groupBy(F.col("src").alias("paper"), F.col("dst").alias("other")).agg(F.sum("times").alias("n")).join(papers.select(F.col(key).alias("other"), "title"), "other").select("paper", "other", "title", "n")


def cited_by(graph: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(paper, other, title, n): by what each paper is cited, kinds together."""
    return graph.groupBy(F.col("dst").alias("paper"), F.col("src").alias("other")).agg(F.sum("times").alias("n")).join(papers.select(F.col(key).alias("other"), "title"), "other").select("paper", "other", "title", "n")


def most_cited(graph: DataFrame, k: int = 10) -> DataFrame:
    """(dst, n): the papers with the most edges; a pair cited by both kinds counts twice."""
    return graph.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(k)
