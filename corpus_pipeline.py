"""The training-data pipeline: quality, recurring lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import frames, queries
from quillspark.llm.decontaminate import without_leaks
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.minhash_dedup import one_of_each
from quillspark.llm.quality import score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    A null text scores as an empty one; a score at the threshold stays; repeated rows stay or go together; rows without
    doc_id are judged by their text. An empty table stays empty. All columns keep their values.
    """
    frames.release(spark)
    (score,) = frames.unused(docs, "_score")
    scored = score_quality(docs, queries.quality_model(spark, docs, sf_dir), score)
    return scored.filter(F.col(score) >= queries.QUALITY_THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; a column n_chars follows the text, all others keep their values.

    Null texts stay null, and rows without doc_id stay as they are. Of a recurring line the largest doc_id keeps all
    its places; repeated rows lose the same lines. A document that loses all lines has an empty text. No row goes.
    """
    frames.release(spark)
    lines, dropped = frames.unused(docs, "_lines", "_dropped")
    out = dedup_lines(docs, n_lines=lines, n_dropped=dropped)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Null and wordless texts and rows without doc_id are nobody's copies and stay. Of rows that repeat a doc_id one
    stays, whatever their texts. An empty table stays empty. All columns keep their values.
    """
    frames.release(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null texts and rows without doc_id stay. Rows that repeat a doc_id go together if any of them leaks, and so does a
    document at the thresholds. Without benchmark or documents nothing goes. All columns keep their values.
    """
    frames.release(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences: the columns of queries.packed(), in place of those of the documents.

    A null text is packed as an empty one; repeated rows and rows without doc_id are packed each. No documents give no
    pieces.
    """
    frames.release(spark)
    return queries.packed(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the classifier, MinHash or the tokeniser: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents. Of the tables between stages, only the last one's input is left in the shared folder."""
    docs = frames.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, frames.stored(stage(spark, docs, sf_dir))
        frames.remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
