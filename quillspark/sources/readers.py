"""Readers of catalogues, texts, vectors, binaries, layout blocks and Atom feeds."""

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.functions.text import is_pdf
from quillspark.functions.workers import ship_package

CATALOGUE_COLUMNS = {"Title": "title", "PDF link": "url", "Authors": "authors", "Topics": "topics", "Release date": "release_date", "Referrer": "referrer"}
BLOCKS = "paper_id string, ord int, text string, font_size double, bold boolean, page int, y_top double"
ATOM = "struct<entry:array<struct<id:string,summary:string,published:string,title:string,author:array<struct<name:string>>,primary_category:struct<_term:string>>>>"


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """(line, title, url, authors, topics, release_date, referrer) of a CSV with a header, all strings; line orders the rows of a file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, path)])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = [(F.col(f"`{a}`") if a in rows.columns else F.lit(None).cast("string")).alias(b) for a, b in CATALOGUE_COLUMNS.items()]
    return rows.select(F.monotonically_increasing_id().alias("line"), *known)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, keyed by the file's stem."""
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("stem", _stem())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _stem():
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, md): whole text files by their stems."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("paper_id"), F.col("value").alias("md"))


def vectors(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """embedded(chunk_id, embedding) of chunks(paper_id, chunk_id), only for papers all of whose chunks have one, and no others."""
    a = chunks.groupBy("paper_id").agg(F.count("*").alias("n"))
    own = embedded.join(chunks.select("paper_id", "chunk_id"), "chunk_id")
    b = own.groupBy("paper_id").agg(F.count("*").alias("n"))
    return own.join(a.join(b, ["paper_id", "n"]).select("paper_id"), "paper_id", "left_semi")


def npy_files(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, n, vectors array<array<float>>, problem) of .npy files, one for each paper, by their stems, from any store that Spark reads.

    A file that is cut off, holds objects, complex numbers or texts, or isn't a matrix has a problem, and null for n and
    vectors. Either order of bytes and of axes is read. Python parses one file at a time; a
    batch holds several, by the session's limits on Arrow batches.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(stem.alias("paper_id"), "content").mapInArrow(_matrices, "paper_id string, n long, vectors array<array<float>>, problem string")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            n, rows, problem = None, None, None
            try:
                own = np.lib.format.read_array(io.BytesIO(batch.column("content")[k].as_py()), allow_pickle=False)
                if own.ndim != 2 or own.dtype.kind not in "fiu":
                    raise ValueError(f"{own.dtype} of {own.ndim} dimensions")
                flat = pa.array(np.ascontiguousarray(own, np.float32).ravel())
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), flat)
                n, rows = len(own), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), inner)
            except (ValueError, EOFError, OverflowError) as e:
                problem = str(e)
            kind = pa.list_(pa.list_(pa.float32()))
            columns = [batch.column("paper_id").slice(k, 1), pa.array([n], pa.int64()), pa.nulls(1, kind) if rows is None else rows.cast(kind), pa.array([problem], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["paper_id", "n", "vectors", "problem"])


def vectors_by_place(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, embedding): row k of a paper's matrix is its k-th chunk's, of chunks(paper_id, chunk_id, idx).

    Only papers with as many vectors as chunks are read; unmatched() names the others.
    """
    whole = files.join(_counts(chunks), "paper_id").filter(F.col("n") == F.col("chunks"))
    rows = whole.select("paper_id", F.posexplode("vectors").alias("place", "embedding"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("idx", "chunk_id")) - 1
    return chunks.select("paper_id", "chunk_id", place.alias("place")).join(rows, ["paper_id", "place"]).select("paper_id", "chunk_id", "embedding")


def unmatched(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, problem) of papers that vectors_by_place() leaves out: unreadable files, other counts, no file, or no chunks."""
    met = files.drop("vectors").withColumn("file", F.lit(True)).join(_counts(chunks), "paper_id", "full_outer")
    counts = F.format_string("%d vectors for %d chunks", "n", F.coalesce("chunks", F.lit(0)))
    why = F.when(F.col("file").isNull(), "no file").when(F.col("n").isNull(), F.col("problem")).when(~F.col("n").eqNullSafe(F.coalesce("chunks", F.lit(0))), counts)
    return met.select("paper_id", why.alias("problem")).filter("problem IS NOT NULL")


def _counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"))


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, content, sha256) of the files that are whole PDFs."""
    files = spark.read.format("binaryFile").load(path).filter(is_pdf("content"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("paper_id"), "content", F.sha2("content", 256).alias("sha256"))


def decode_blocks(files: DataFrame, decoder: Callable[[bytes], list[dict]]) -> DataFrame:
    """Layout blocks of files(paper_id, content); decoder turns bytes into dicts of text, font_size, bold, page and y_top. Empty blocks are left out."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"paper_id": i, "ord": k, **block} for i, content in zip(batch["paper_id"], batch["content"], strict=True) for k, block in enumerate(b for b in decoder(content) if b["text"].strip())]
            yield pd.DataFrame(rows, columns=["paper_id", "ord", "text", "font_size", "bold", "page", "y_top"])

    return files.select("paper_id", "content").mapInPandas(run, BLOCKS)


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(arxiv_id, abstract, published, category, authors) of Atom feeds; what cannot be parsed gives nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.col(xml), r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    entries = feeds.select(F.explode(F.from_xml(bare, ATOM.removeprefix("struct<").removesuffix(">").replace("entry:array", "entry array", 1), {"mode": "PERMISSIVE"})["entry"]).alias("e"))
    squeezed = F.trim(F.regexp_replace(F.col("e.summary"), r"\s+", " "))
    return entries.select(
        F.regexp_replace(F.regexp_extract("e.id", r"abs/(.+)$", 1), r"v\d+$", "").alias("arxiv_id"), squeezed.alias("abstract"), F.substring("e.published", 1, 10).alias("published"),
        F.col("e.primary_category._term").alias("category"), F.transform("e.author", lambda a: F.trim(a["name"])).alias("authors"),
    )


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest written by sinks.manifest(); empty if there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
