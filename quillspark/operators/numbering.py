"""Dense numbers for rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.storage import checkpointed

_ROWS_OF_A_PARTITION = 1 << 33  # monotonically_increasing_id() puts the partition above this


def dense_ids(rows: DataFrame, order: list[str], name: str = "rowid", first: int = 1) -> DataFrame:
    """rows with `name`: first, first + 1, ... in the order of the columns `order` (nulls first).

    Two passes: the rows are range partitioned and sorted once, as a checkpoint, with their place in their partition;
    one count for each partition then gives the partitions' offsets. What the driver sees is these counts. Rows that are
    equal in `order` get neighbouring numbers in any order. Give narrow rows and join them to wide ones by their key.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % _ROWS_OF_A_PARTITION).alias("_place"))
    placed = checkpointed(placed)
    offsets, total = [], first
    for part in sorted(placed.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        offsets.append((part["_part"], total))
        total += part["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).select(*rows.columns, name)


def chunk_rowids(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, chunk_rowid) of chunks(paper_id, chunk_id, idx): numbers from 1 by paper and place in it."""
    return dense_ids(chunks.select("paper_id", "idx", "chunk_id"), ["paper_id", "idx", "chunk_id"], "chunk_rowid").select("paper_id", "chunk_id", "chunk_rowid")
