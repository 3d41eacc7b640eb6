"""Views that give the generic tables the shapes of papers, chunks and cited texts; the SQL runs in Spark and DuckDB alike."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import padded

PAPERS = """
SELECT doc_id, concat('doc-', lpad(cast(doc_id AS string), 6, '0')) AS paper_id,
       substr(split_part(text, chr(10), 1), 1, 80) AS title,
       concat('Ana A', cast(doc_id % 17 AS string), ', Bo B', cast(doc_id % 5 AS string)) AS authors,
       cast(date '2020-01-01' + cast(doc_id % 1500 AS int) AS string) AS release_date,
       CASE WHEN doc_id % 10 = 0 THEN concat('https://doi.org/10.1000/x', cast(doc_id AS string))
            ELSE concat('https://arxiv.org/pdf/2001.', lpad(cast(doc_id AS string), 5, '0'), 'v1.pdf') END AS pdf_url,
       substr(text, 1, 300) AS abstract, text, lang, source
FROM {documents}
"""
CITED = """
SELECT paper_id, concat(text, ' see arXiv:2001.', lpad(cast((doc_id * 3 + 2) % 1000 AS string), 5, '0'),
       'v2 and 2001.', lpad(cast((doc_id * 13 + 2) % 1000 AS string), 5, '0'),
       ', doi 10.1000/x', cast((doc_id * 3) % 1000 AS string), '.') AS md
FROM ({papers}) p
"""
# A raw catalogue with versions and dates of the same papers.
CATALOGUE = """
SELECT o_orderkey AS line, concat('Paper No ', cast(o_orderkey % 700 AS string)) AS title,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('http://arxiv.org/abs/2001.', lpad(cast(o_orderkey % 700 AS string), 5, '0'), 'v', cast(o_orderkey * 7 % 5 AS string))
            WHEN o_orderkey % 3 = 1 THEN concat('https://arxiv.org/pdf/2001.', lpad(cast(o_orderkey % 700 AS string), 5, '0'), 'v', cast(o_orderkey * 11 % 4 AS string), '.pdf')
            ELSE concat(' https://eprint.iacr.org/2020/', cast(o_orderkey % 700 AS string), '/ ') END AS url,
       'Ana A' AS authors, 'a, b ,,c' AS topics, substr(cast(o_orderdate AS string), 1, 10) AS release_date, '' AS referrer
FROM {orders}
"""
SECTIONS = ("", "Introduction", "Methods", "Results", "Discussion", "Conclusion")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(PAPERS.replace("{documents}", "{d}"), d=read(spark, sf_dir, "documents"))
    # The SQL cuts numbers of more than six digits.
    return found.withColumns({"paper_id": F.concat(F.lit("doc-"), padded("doc_id", 6)), "topics": F.array("lang", "source")})


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CITED.replace("({papers})", "{p}"), p=papers(spark, sf_dir))


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOGUE.replace("{orders}", "{o}"), o=read(spark, sf_dir, "orders"))


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One chunk a line, with a section label by its place, and with more columns of its paper."""
    lines = papers(spark, sf_dir).select("doc_id", "paper_id", *more, F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("idx") % 6 + 1)
    return lines.select("doc_id", "paper_id", "idx", F.concat("paper_id", F.lit("::"), padded("idx", 4)).alias("chunk_id"), section.alias("section"), "text", *more)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks: each line; every fourth is numbered, every fourth in a larger font."""
    c = chunks(spark, sf_dir)
    text = F.when(F.col("idx") % 4 == 1, F.concat(F.lit("2.1 "), "text")).otherwise(F.col("text"))
    size = F.when(F.col("idx") % 4 == 3, 14.0).otherwise(10.0)
    return c.select("paper_id", F.col("idx").alias("ord"), text.alias("text"), size.alias("font_size"), (F.floor(F.col("idx") / 2) + 1).cast("int").alias("page"))


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with one section for each line."""
    c = chunks(spark, sf_dir)
    piece = F.when(F.col("section") == "", F.col("text")).otherwise(F.concat(F.lit("## "), "section", F.lit("\n\n"), "text"))
    return c.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("md"))


P = PAPERS.replace("{documents}", "documents")
LINES = f"(SELECT doc_id, paper_id, i - 1 AS idx, ls[i] AS text, paper_id || '::' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') AS chunk_id FROM (SELECT doc_id, paper_id, string_split(text, chr(10)) AS ls FROM ({P}) p) t, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) r)"
BLOCKS = f"(SELECT paper_id, idx AS ord, CASE WHEN idx % 4 = 1 THEN '2.1 ' || text ELSE text END AS text, CASE WHEN idx % 4 = 3 THEN 14.0 ELSE 10.0 END AS font_size, CAST(idx // 2 + 1 AS INT) AS page FROM {LINES} l)"
