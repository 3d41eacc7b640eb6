"""Sending this package to executors that do not have it installed."""

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch sent to Python. Texts can be long, so batches are short: memory stays bounded.
ARROW_ROWS, ARROW_BYTES = 512, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session.

    Plans are executed long after the operator has returned, with the settings of then, so the bounds stay. A session
    that has smaller ones keeps them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def ship_package(spark: SparkSession | None = None) -> None:
    """Add the package to the Python path of the executors, once for each application."""
    sc = (spark or SparkSession.active()).sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillspark-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(archive := f"{folder}/quillspark_code.zip", "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
