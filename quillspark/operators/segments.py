"""An index that takes additions, changes and deletions: immutable segments, tombstones, merges by size.

A folder holds segments/<name>/ (rows and slices of one BlockIndex, as its making stored them),
dead/version=<n>/ (segment, id: documents that a later segment replaced or that were deleted) and versions/version=<n>/
(one row for each segment of a version). A version's own file is written last, as one file, so a job that is killed
leaves the version before it; what it had written is not referred to by any version, and may be removed with vacuum().

A search of a version gives the scores of an index built anew. Statistics are those of the live documents; impacts in a
slice are bounds by its own average length in any case, so they are for those of any version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.storage import stored
from quillspark.operators import inverted

#: So many segments of about one size (within this factor) are merged; a segment is rewritten when this share of it is dead.
FANOUT, DEAD_SHARE = 8, 0.25


class SegmentedIndex:
    """The index of documents(key, fields...) in a folder that the executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], analysers: dict[str, Callable] | None = None) -> None:
        self.spark, self.path, self.key, self.fields, self.analysers = spark, path, key, fields, analysers

    # --- versions -----------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The last version; 0 before the first one."""
        return max(self._written("versions"), default=0)

    def _written(self, table: str) -> list[int]:
        return [int(name.removeprefix("version=")) for name in self._names(table)]

    def _names(self, table: str) -> list[str]:
        """Folders of a table that hold a file of rows."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        folders = [x.getPath() for x in files.listStatus(where) if x.isDirectory()]
        return [f.getName() for f in folders if table == "segments" or any(x.getPath().getName().startswith("part-") for x in files.listStatus(f))]

    def segments(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(segment, documents, dead ones) of a version, larger ones first."""
        n = self.version() if version is None else version
        if not n:
            return []
        rows = self.spark.read.parquet(f"{self.path}/versions/version={n}").collect()
        return sorted(((r["segment"], r["docs"], r["dead"]) for r in rows), key=lambda r: (-r[1], r[0]))

    def _commit(self, n: int, segments: list[str], dead: DataFrame | None) -> None:
        """Write version n of these segments."""
        spark = self.spark
        held = {s: 0 for s in segments}
        if dead is not None:
            dead.write.mode("overwrite").parquet(f"{self.path}/dead/version={n}")
            held |= {r["segment"]: r["count"] for r in spark.read.parquet(f"{self.path}/dead/version={n}").groupBy("segment").count().collect()}
        docs = {r["segment"]: r["docs"] for r in self._heads(segments).groupBy("segment").agg(F.sum(F.size("ids")).alias("docs")).collect()} if segments else {}
        rows = [(s, docs.get(s, 0), held[s]) for s in segments]
        spark.createDataFrame(rows, "segment string, docs long, dead long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={n}")

    def _at(self, segment: str, table: str) -> str:
        return f"{self.path}/segments/{segment}/{table}"

    def _each(self, table: str, segments: list[str]) -> DataFrame:
        """A table of several segments, with their names."""
        own = [self.spark.read.parquet(self._at(s, table)).withColumn("segment", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, own)

    def _heads(self, segments: list[str]) -> DataFrame:
        """(segment, slice, ids) of slices, each once."""
        return self._each("slices", segments).filter(F.col("field") == self.fields[0]).select("segment", "slice", "ids")

    def _dead(self, n: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/dead/version={n}") if n and any(d for _, _, d in self.segments(n)) else None

    # --- changes ------------------------------------------------------------------------------------------------

    def apply(self, docs: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """A new version: docs(key, fields...) are added or replace those of the same key, deleted(key) go; its number.

        key is unique in docs and not null; a key in both is in the new version. Keys of deleted that the index doesn't
        have change nothing. Only the new documents are read and analysed, and the keys of the older ones.
        """
        n = self.version()
        old = [s for s, _, _ in self.segments(n)]
        gone = [x.select(F.col(self.key).alias("id")) for x in (docs, deleted) if x is not None]
        dead = self._dead(n)
        if old and gone:
            ids = self._heads(old).select("segment", F.explode("ids").alias("id")).join(reduce(DataFrame.union, gone).distinct(), "id", "left_semi").select("segment", "id")
            dead = (ids if dead is None else ids.union(dead.select("segment", "id"))).distinct()
        segments = [*old, self._add(docs)] if docs is not None else old
        self._commit(n + 1, segments, dead)
        return n + 1

    def _add(self, docs: DataFrame) -> str:
        segment = uuid.uuid4().hex
        inverted.build(docs, self.key, self.fields, self.analysers, f"{self.path}/segments/{segment}")
        return segment

    def merge(self, fanout: int = FANOUT, dead_share: float = DEAD_SHARE) -> int | None:
        """A new version in which `fanout` segments of about one size are one, and segments with many dead ones are rewritten
        without them; its number, or None if there is nothing to merge. No text is read: segments hold all that is needed.
        """
        n, tiers = self.version(), {}
        segments = self.segments(n)
        for s, docs, dead in segments:
            tiers.setdefault(_tier(docs - dead, fanout), []).append(s)
        groups = [own for own in tiers.values() if len(own) >= fanout]
        taken = {s for own in groups for s in own}
        groups += [[s] for s, docs, dead in segments if s not in taken and dead and dead >= dead_share * docs]
        if not groups:
            return None
        dead, kept = self._dead(n), [s for s, _, _ in segments if all(s not in own for own in groups)]
        new = [self._merged(own, dead) for own in groups]
        left = None if dead is None else dead.filter(F.col("segment").isin(kept))
        self._commit(n + 1, [*kept, *new], left)
        return n + 1

    def _merged(self, segments: list[str], dead: DataFrame | None) -> str:
        segment = uuid.uuid4().hex
        inverted.merged(self._blocks(segments), self._slices(segments, segments, dead), f"{self.path}/segments/{segment}")
        return segment

    def vacuum(self) -> list[str]:
        """Remove the segments that the last version doesn't have, and all earlier versions; nobody may be reading them."""
        n, kept = self.version(), {s for s, _, _ in self.segments()}
        old = [f"segments/{s}" for s in self._names("segments") if s not in kept]
        old += [f"{t}/version={v}" for t in ("versions", "dead") for v in self._written(t) if v != n]
        for name in old:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return old

    # --- searches -----------------------------------------------------------------------------------------------

    def open(self, version: int | None = None) -> inverted.BlockIndex:
        """A version as one index, for inverted.search(), matches() and phrases() and for grammar.search()."""
        n = self.version() if version is None else version
        listed = self.segments(n)
        if not listed:
            raise ValueError("nothing has been indexed")
        names, spoilt = [s for s, _, _ in listed], [s for s, _, d in listed if d]
        slices = stored(self._slices(names, spoilt, self._dead(n)))
        return inverted.BlockIndex(self._blocks(names), slices, stored(inverted.stats_of(slices)), bool(spoilt))

    def _blocks(self, segments: list[str]) -> DataFrame:
        rows = self._numbered("rows", segments).filter("term IS NOT NULL")
        return rows.select("slice", "field", "term", "n", "most", "kth", "docs", "tfs", "deltas")

    def _slices(self, segments: list[str], spoilt: list[str], dead: DataFrame | None) -> DataFrame:
        """The slices of segments, of which those in spoilt have documents in dead(segment, id): live says which are left."""
        slices = self._numbered("slices", segments).drop("segment")
        if dead is None or not spoilt:
            return slices
        own = self._numbered("slices", segments).filter(F.col("segment").isin(spoilt) & (F.col("field") == self.fields[0]))
        each = own.select("segment", "slice", F.posexplode("ids").alias("doc", "id"))
        flags = each.join(dead.withColumn("dead", F.lit(True)), ["segment", "id"], "left").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("doc", F.col("dead").isNull().alias("live")))).alias("x"))
        live = flags.select("slice", F.col("x.live").alias("live")).filter(F.exists("live", lambda x: ~x))
        return slices.drop("live").join(live, "slice", "left").select(*slices.columns)

    def _numbered(self, table: str, segments: list[str]) -> DataFrame:
        """A table of several segments, in which each slice has a number of its own."""
        own = [self.spark.read.parquet(self._at(s, table)).withColumns({"segment": F.lit(s), "slice": F.col("slice") + F.lit(i << 48)}) for i, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, own)


def _tier(n: int, base: int) -> int:
    """How many digits n has to this base."""
    out = 0
    while n > 0:
        n, out = n // base, out + 1
    return out
