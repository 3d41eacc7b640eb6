"""Removal of lines that recur across documents, with compressed keep bitmaps. DataFrame operations only.

Lines are counted by a hash first, combined before the shuffle, so that only lines that may be frequent go on. Those
are range-partitioned on key hash and part, and sorted by document and position inside each partition. A line that very
many documents hold is cut into parts by document, as many as its rough count asks for, so no task gets all of it. One
pass over the sorted rows marks the first row of each document and the first of each line; each part of a line then
gives one row (documents, largest document), and these are combined. What comes back for a document is a run-length
bitmap of the lines it keeps, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.frames import BROADCAST_ROWS, cut, partitions_for, unused

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bitmaps are broadcast to the texts only if there are at most so many runs in all (16 bytes each, and 50 a document).
BROADCAST_RUNS = 1_000_000
#: Rows of one line that make a part of their own.
PART_ROWS = 250
#: Parts that a side of a join is dealt into where the other is too large to be broadcast.
SALTS = 32


def _join_by_line(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with the distinct keys of `few` (a checkpoint): by broadcast if it is small, else with rows of one line spread by document."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) for each document that loses lines.

    A line's key is the line without ASCII white space at both ends and with A-Z lowered. Keys of at least min_chars
    code points in at least min_docs documents lose all their lines but those of the largest doc_id. keep lists the
    runs of kept lines as (first, length), from 0. Rows with the same doc_id are one document in counting, and are
    told apart by text_hash. Rows without doc_id or text neither count nor lose lines.
    """
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = known.select("doc_id", F.posexplode(_lines()).alias("pos", "line"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= min_chars)
    # lower() joins at least what lowering A-Z joins, and is much faster than translate(): it only selects candidates.
    rough = rows.withColumn("rough", F.xxhash64(F.lower("line")))
    frequent = cut(rough.groupBy("rough").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("rough", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("n_parts")))
    key = F.translate("line", _UPPER, _LOWER)
    part = F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int").alias("part")
    maybe = cut(_join_by_line(rough, frequent, ["rough"]).select(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"), part, "doc_id", "text_hash", "pos"))

    line = ["k1", "k2", "part"]
    # The range partitions and their order are those that the window asks for: it streams over them as they are.
    ordered = maybe.repartitionByRange(partitions_for(docs.sparkSession, maybe.count()), *line).sortWithinPartitions(*line, F.desc("doc_id"), "pos")
    before = F.lag("doc_id").over(Window.partitionBy(*line).orderBy(F.desc("doc_id"), "pos"))
    streamed = cut(ordered.withColumn("before", before))
    # The first row of a line in a part has no row before it: its document is the part's largest.
    firsts = streamed.filter(F.col("before").isNull() | (F.col("before") != F.col("doc_id")))
    keys = firsts.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max(F.when(F.col("before").isNull(), F.col("doc_id"))).alias("keeper"))
    keys = cut(keys.filter(F.col("n_docs") >= min_docs).select("k1", "k2", "keeper"))
    lost = _join_by_line(streamed, keys, ["k1", "k2"]).filter("doc_id < keeper")
    dropped = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    # The run before each dropped line; the one after the last has the greatest length and ends with the text.
    run = F.transform(
        F.sequence(F.lit(0), F.size("drop")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get("drop", i - 1) + 1).alias("first"),
            (F.coalesce(F.get("drop", i), F.lit(2**31 - 1)) - F.when(i == 0, F.lit(0)).otherwise(F.get("drop", i - 1) + 1)).alias("length"),
        ),
    )
    return dropped.select("doc_id", "text_hash", F.size("drop").cast("long").alias("n_dropped"), F.filter(run, lambda r: r["length"] > 0).alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs(doc_id, text, ...) with recurring lines taken out of text, and n_lines and n_dropped added under the names given.

    See line_bitmaps. Columns of these two names are replaced; all others stay, whatever they are called. A null text
    stays null and counts as one empty line. A document that loses all its lines has an empty text. Repeated rows lose
    the same lines. An empty table gives an empty result.
    """
    doc, text_hash, dropped, keep = unused(docs, "_doc", "_hash", "_dropped", "_keep")
    bitmaps = cut(line_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep)))
    size = bitmaps.agg(F.sum(F.size(keep) + 4)).first()[0] or 0
    side = F.broadcast(bitmaps) if size <= BROADCAST_RUNS else bitmaps
    lines = _lines()
    kept = F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["length"]))), "\n")
    joined = docs.join(side, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    added = (n_lines.lower(), n_dropped.lower())
    own = [F.when(F.col(doc).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return joined.select(*own, F.size(lines).cast("long").alias(n_lines), F.coalesce(dropped, F.lit(0).cast("long")).alias(n_dropped))
