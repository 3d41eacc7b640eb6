"""Writers of papers, chunks, indexes, manifests and responses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.lexical import TextIndex


def per_paper_json(rows: DataFrame, path: str, key: str = "paper_id") -> None:
    """JSON lines in one folder for each paper."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, sorted by a key within files so that lookups skip row groups."""
    (rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows).write.mode("overwrite").parquet(path)


def index(own: TextIndex, path: str, buckets: int = 64) -> None:
    """An inverted index: postings in partitions by a hash of the term, so that a query reads those of its terms only."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    own.postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    own.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark, path: str, terms: list[str] | None = None, buckets: int = 64) -> TextIndex:
    """An index written by index(); with terms, only the partitions that hold them are read."""
    postings = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    return TextIndex(postings.drop("bucket"), spark.read.parquet(f"{path}/stats"))


def manifest(rows: DataFrame, path: str, key: str = "paper_id") -> None:
    """A manifest in the order of its keys."""
    rows.orderBy(key).write.mode("overwrite").json(path)


def responses(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
