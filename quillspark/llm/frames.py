"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.workers import bound_batches, ship_package

#: A side of a join is broadcast only when a count shows it has at most so many rows (of two or three longs each).
BROADCAST_ROWS = 1_000_000
#: Narrow rows of a task of a shuffle whose number of partitions is fixed.
TASK_ROWS = 1_000_000
#: Narrow rows of a file of a checkpoint whose number of rows is known.
FILE_ROWS = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def python_workers(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, and send this package to the executors, where it may not be installed."""
    bound_batches(spark)
    ship_package(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset, on a single machine."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Checkpoint df in the shared folder and go on from there.

    If df is known to have at most so many narrow rows, they are put into as few files as these fill; each shuffle
    that follows then writes as few.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; for rows with texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    _paths[id(out)] = (out, path)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def remove(table: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more; other tables are left alone."""
    if id(table) in _paths:
        _, path = _paths.pop(id(table))
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the driver give back what earlier jobs left behind, at the beginning of a stage.

    Spark removes broadcasts, shuffle files and checkpoints when the driver's collector finds them unused, which is every
    half hour unless the heap is full. Plans that Python still refers to in cycles are dropped first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(spark: SparkSession, rows: int, of_a_task: int = TASK_ROWS) -> int:
    """How many partitions a shuffle of so many rows gets: the session's number, or more if tasks would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // of_a_task))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df has it (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, with a broadcast hint if it is proven to be small. df should be a checkpoint: it is counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches. Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        a, own = 0, list(zip(*columns, strict=True))
        for i in range(len(own)):
            if own[i] != (own[a] if i > a else last):
                if i > a:
                    held.append(batch.slice(a, i - a))
                if held:
                    yield pa.Table.from_batches(held)
                held, a = [], i
                last = own[i]
        held.append(batch.slice(a))
        last = own[-1]
    if held:
        yield pa.Table.from_batches(held)
