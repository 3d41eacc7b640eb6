"""Cutting the lineage of plans in a folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset, on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read from there."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows, written to the shared folder (or to path) as Parquet and read from there: packed by column, of which a reader takes what it needs."""
    path = path or f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4()}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
