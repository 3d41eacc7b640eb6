"""Files written one for each row, and listed once all of them are there.

Tasks write each file beside its place and move it there, so a file is whole or absent, and an attempt that is repeated
replaces it by itself. What a task has written it lists in a part of its own, under the writing's number; the commit only
writes which parts count, as one small file that is moved into place. A reader trusts that file. Neither names nor
contents pass the driver, except for the number of each task's part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.functions.storage import checkpointed, path_exists
from quillspark.functions.text import is_pdf
from quillspark.functions.workers import ship_package

LISTED = "name string, bytes long, sha256 string"
_COMMIT = "_lists/committed.json"


@dataclass
class Part(WriterCommitMessage):
    name: str | None


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    beside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(beside) as out:
        out.write(content)
    store.move(beside, path)


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        store, folder = _place(path)
        store.create_dir(f"{folder}/_lists/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = _place(self.path)
        part, lines = uuid.uuid4().hex, None
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name[0] in "._" or "/" in name or content is None:
                    raise ValueError(f"no file can be written under the name {name!r}")
                _put(store, f"{folder}/{name}", content)
                if lines is None:
                    lines = store.open_output_stream(f"{folder}/_lists/{self.job}/{part}.json")
                lines.write(json.dumps({"name": name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}).encode() + b"\n")
        if lines is None:
            return Part(None)
        lines.close()
        return Part(f"{part}.json")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _place(self.path)
        _put(store, f"{folder}/{_COMMIT}", json.dumps({"list": self.job, "parts": sorted(m.name for m in messages if m and m.name)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _place(self.path)
        store.delete_dir(f"{folder}/_lists/{self.job}")


class FileEach(DataSource):
    """A sink of (name string, content binary) as files in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "file_each"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Write rows(name, content) to files of their own in a folder, then list them; see listed().

    Names are distinct (else it raises before anything is written, so rows is read twice), not empty, hold no slash and
    begin with no dot or underscore; contents are not null. Files of earlier writings stay where no row has their name;
    the list is that of the last writing that ended. No rows give an empty list. Other columns are ignored.
    """
    spark = rows.sparkSession
    repeated = rows.groupBy("name").count().filter("count > 1").select("name").first()
    if repeated is not None:
        raise ValueError(f"several rows have the name {repeated['name']!r}")
    ship_package(spark)
    spark.dataSource.register(FileEach)
    rows.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format("file_each").option("path", _absolute(path)).mode("append").save()


def _absolute(path: str) -> str:
    return path if "://" in path or path.startswith("file:/") else f"file://{path}"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files of the last writing to a folder that ended; empty if none has."""
    if not path_exists(spark, f"{path}/{_COMMIT}"):
        return spark.createDataFrame([], LISTED)
    last = spark.read.schema("list string, parts array<string>").json(f"{path}/{_COMMIT}").select("list", F.explode_outer("parts").alias("part"))
    job = last.first()["list"]
    if last.filter("part IS NOT NULL").isEmpty():
        return spark.createDataFrame([], LISTED)
    lines = spark.read.schema(LISTED).json(f"{path}/_lists/{job}")
    lines = lines.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"))
    # Attempts that were lost may have left parts of their own.
    return lines.join(last.select("part"), "part", "left_semi").drop("part")


def json_each(rows: DataFrame, path: str, key: str = "paper_id") -> None:
    """One JSON object a row, in a file named by its key, and the list of them."""
    write_files(rows.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), F.encode(F.to_json(F.struct("*")), "UTF-8").alias("content")), path)


def import_files(inbox: DataFrame, matches: DataFrame, path: str, save: Callable[[DataFrame], None]) -> DataFrame:
    """Copy matched PDFs to <candidate>.pdf in a folder, have the manifest saved, and delete their sources.

    inbox(path, content) are files as Spark's binaryFile gives them, matches(file, candidate) name files by their stem. Of
    several files of one candidate the last by path is copied, and all are deleted; whatever is no whole PDF or has no
    candidate stays. save gets (paper_id, status, bytes, sha256, source, error) of the list of what was copied, to be
    upserted; the same is returned. Sources go only after it has ended, those that were not copied first: so a run that
    was lost at any point ends with the same files and manifest when it is run again.
    """
    whole = inbox.filter(is_pdf("content", 8_000)).withColumn("file", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    paired = checkpointed(whole.select("path", "file").join(matches.select("file", "candidate").filter("candidate IS NOT NULL").distinct(), "file"))
    last = paired.groupBy("candidate").agg(F.max("path").alias("path"))
    write_files(inbox.select("path", "content").join(last, "path").select(F.concat("candidate", F.lit(".pdf")).alias("name"), "content"), path)
    done = listed(inbox.sparkSession, path).select(
        F.regexp_replace("name", r"\.pdf$", "").alias("paper_id"), F.lit("ok").alias("status"), "bytes", "sha256", F.lit("manual").alias("source"), F.lit(None).cast("string").alias("error")
    )
    save(done)
    for sources in (paired.select("path").distinct().join(last, "path", "left_anti"), last.select("path").distinct()):
        sources.mapInArrow(_delete, "path string").write.format("noop").mode("overwrite").save()
    return done


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, own = _place(path)
            if store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_file(own)
        yield batch
