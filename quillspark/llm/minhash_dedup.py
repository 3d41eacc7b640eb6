"""Near-duplicate groups by MinHash with tensored banding and exact verification.

Two collections of `halves` short MinHash bands are computed for each document. A table key is a pair, one band of each
collection, so halves ** 2 tables need only 2 * halves bands: 80 MinHash values stand for 100 tables of 8 values, where
plain banding would compute 800. A pair with Jaccard similarity s shares a table with probability
(1 - (1 - s ** rows) ** halves) ** 2: with ten bands of four rows 0.999 at 0.85, 0.006 at 0.3. Only bands that some
other text has are paired.

Documents with the same shingle set are one text and are collapsed first. Every text is compared, on the full sets,
with the least text of each of its tables; that is linear in the texts, however large a table is, and joins most of
what belongs together. What is left are tables whose texts are not yet of one component. They are joined to clusters,
or stay by themselves where that sends fewer sets, and inside each, all pairs of texts of different components are
decided by whichever task holds the two blocks they belong to. So no link between texts that met in a
table is lost and none is unverified; a pair of blocks returns only a spanning forest of its links. In a cluster, texts
that met in no table of their own are compared too, so a true link may be found that the tables alone would miss (with
a probability of 0.001 at the threshold); which way a cluster goes never decides about a pair that met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytewords as bw
from quillspark.llm.components import connected_components
from quillspark.llm.frames import bounded_broadcast, cut, groups, partitions_for, python_workers, unused

#: Most texts and most shingles of a block of candidates.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 2_000_000
#: Texts that one task compares with the least text of a table, and sets that a task gets in all, roughly.
STAR_TEXTS, TASK_SETS = 256, 20_000


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    data, offsets = bw.column_bytes(batch.column("text"))
    for a, b in bw.blocks(offsets):
        w = bw.Words(data, offsets, a, b, bw.SPACE)
        for k in range(b - a):
            yield bw.shingle_hashes(w.hash[w.first[k] : w.first[k + 1]], words)


def _bands(shingles: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of `rows` MinHash values."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 256):
            np.minimum(least, (shingles[a : a + 256, None] * multipliers).min(axis=0), out=least)
        weights = bw.seeds(rows, 31)
        return bw._mix((least.reshape(-1, rows) * weights).sum(axis=1, dtype=np.uint64))


def _signatures(words: int, halves: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = bw.seeds(2 * halves * rows, 5)
        for batch in batches:
            out: dict[str, list] = {"n_shingles": [], "s1": [], "s2": [], "bands": []}
            for s in _sets(batch, words):
                out["n_shingles"].append(len(s))
                with np.errstate(over="ignore"):
                    out["s1"].append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                    out["s2"].append(int(bw._mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                out["bands"].append(_bands(s, multipliers, rows).view(np.int64).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(out["n_shingles"], pa.int64()), pa.array(out["s1"], pa.int64()), pa.array(out["s2"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _with_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "n_shingles", "shingles"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < per_cent * max(len(x), len(y)):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= per_cent * (len(x) + len(y) - shared)


def _verify(per_cent: int):
    """Links of texts with the head of their group; only the head is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heads = None, []
        for batch in batches:
            u, v = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("head", "part", "member", "doc_id", "shingles")), strict=True)
            for head, part, member, doc_id, shingles in rows:
                if (head, part) != own:
                    own, heads = (head, part), []
                x = np.frombuffer(shingles, np.uint64)
                if not member:
                    heads.append(x)
                elif any(_similar(x, y, per_cent) for y in heads):
                    u.append(doc_id)
                    v.append(head)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _forest(ids: list[int], sets: list[np.ndarray], side: np.ndarray, same: bool, per_cent: int, component: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what is linked among the sets and not of one component already; between the two sides only, unless they are the same block."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[at]
    owner, at = owner[keep], number[at[keep]]
    width = int(common.sum())
    root = np.arange(n) if component is None else np.unique(np.array(component, np.int64), return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    dense = width and n * width <= 256_000_000
    if dense:
        bits = np.zeros((n, (width + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    else:
        order = np.argsort(at, kind="stable")
        by_value, ends = owner[order], np.cumsum(np.bincount(at, minlength=width)) if width else np.zeros(0, np.int64)
        own_ends = np.searchsorted(owner, np.arange(n), "right")
    for i in range(n):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not same:
            others = others[side[others] != side[i]]
        s = sizes[others]
        others = others[(100 * np.minimum(s, sizes[i]) >= per_cent * np.maximum(s, sizes[i]))]
        if not len(others) or not width:
            continue
        if dense:
            shared = np.empty(len(others), np.int64)
            for a in range(0, len(others), 1024):
                shared[a : a + 1024] = np.bitwise_count(bits[others[a : a + 1024]] & bits[i]).sum(axis=1, dtype=np.int64)
        else:
            mine = at[(own_ends[i - 1] if i else 0) : own_ends[i]]
            total = np.zeros(n, np.int64)
            for v in mine:
                total[by_value[(ends[v - 1] if v else 0) : ends[v]]] += 1
            shared = total[others]
        for j in others[100 * shared >= per_cent * (sizes[others] + sizes[i] - shared)]:
            if root[j] != root[i]:
                found.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return found


def _resolve(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for table in groups(batches, ["cluster", "by_table", "i", "j"]):
            ids = table.column("doc_id").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            for x, y in _forest(ids, sets, np.array(table.column("block").to_pylist()), i == j, per_cent, table.column("component").to_pylist()):
                u.append(x)
                v.append(y)
            if len(u) > 10_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _tables(texts: DataFrame, halves: int) -> DataFrame:
    """(rep, n_shingles, key) of the tables that may hold more than one text."""
    bands = texts.select("rep", "n_shingles", F.posexplode("bands").alias("at", "band"))
    shared = bands.groupBy("at", "band").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    own = bands.join(shared, ["at", "band"]).groupBy("rep", "n_shingles").agg(F.collect_list(F.struct("at", "band")).alias("own"))
    first, second = F.filter("own", lambda x: x["at"] < halves), F.filter("own", lambda x: x["at"] >= halves)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["at"], y["at"], x["band"], y["band"]))))
    return own.select("rep", "n_shingles", F.explode(keys).alias("key"))


def _star_links(tables: DataFrame, n: int, sets: DataFrame, per_cent: int) -> DataFrame:
    """(u, v): the links of each text with the least text of each of its tables. A head's texts are dealt in parts."""
    heads = tables.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("h"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("h.rep").alias("head"), F.col("h.n_shingles").alias("n_head"))
    near = 100 * F.least("n_shingles", "n_head") >= per_cent * F.greatest("n_shingles", "n_head")
    pairs = cut(tables.join(heads, "key").filter((F.col("rep") != F.col("head")) & near).select("rep", "head").distinct(), n)
    sizes = cut(pairs.groupBy("head").agg(F.ceil(F.count("*") / STAR_TEXTS).cast("int").alias("parts")), n)
    members = pairs.join(bounded_broadcast(sizes), "head").select("head", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), F.col("rep").alias("doc_id"))
    own = sizes.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("head").alias("doc_id"))
    dealt = members.unionByName(own).join(sets.select("doc_id", "shingles"), "doc_id")
    tasks = partitions_for(sets.sparkSession, pairs.count(), TASK_SETS)
    return dealt.repartition(tasks, "head", "part").sortWithinPartitions("head", "part", "member").select("head", "part", "member", "doc_id", "shingles").mapInArrow(_verify(per_cent), "u long, v long")


def _block_links(tables: DataFrame, n: int, components: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame | None:
    """(u, v): links between texts of one table but of different components; None if there can be none.

    A table's least text has been compared with all others, so a table of two texts is done.
    """
    placed = cut(tables.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"), "n_shingles"), n)
    of_table = [F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("n"), F.sum("n_shingles").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("y")]
    mixed = placed.groupBy("key").agg(*of_table).filter("first != last AND n > 2")
    mixed = cut(mixed.groupBy("first", "n", "m", "x", "y").agg(F.min("key").alias("key")), n)  # tables with the same texts are one
    n_mixed = mixed.count()
    if not n_mixed:
        return None
    # Tables with a component in common are one cluster, of components first.
    met = placed.join(bounded_broadcast(mixed.select("key", "first"), n_mixed), "key")
    together = cut(connected_components(cut(met.select(F.col("component").alias("u"), F.col("first").alias("v")).filter("u != v").distinct(), n)), n)
    cluster = bounded_broadcast(together.select(F.col("node").alias("component"), F.col("component").alias("cluster")))
    texts = cut(met.select("rep", "component", "n_shingles").distinct().join(cluster, "component"), n)

    # How many sets the pairs of blocks of a cluster get, and those of its tables by themselves: the fewer.
    def of_blocks(n: str, m: str) -> Column:
        return F.ceil(F.greatest(F.col(n) / BLOCK_TEXTS, F.col(m) / BLOCK_SHINGLES)).cast("int")

    whole = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    single = mixed.join(cluster, F.col("first") == F.col("component")).groupBy("cluster").agg(F.sum(F.col("n") * of_blocks("n", "m")).alias("sent"))
    sizes = cut(whole.join(single, "cluster").select("cluster", (F.col("n") * of_blocks("n", "m") > F.col("sent")).alias("by_table")), n_mixed)
    small = texts.join(bounded_broadcast(sizes.filter("NOT by_table")), "cluster").select("cluster", "by_table", "rep", "component", "n_shingles")
    large = texts.select("rep", "cluster").join(bounded_broadcast(sizes.filter("by_table")), "cluster").select("rep", "by_table")
    large = met.join(large, "rep").select(F.col("key").alias("cluster"), "by_table", "rep", "component", "n_shingles")
    every = cut(small.unionByName(large), n)
    blocks = every.groupBy("cluster", "by_table").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).select("cluster", "by_table", of_blocks("n", "m").alias("n_blocks"))
    every = every.join(bounded_broadcast(cut(blocks, n)), ["cluster", "by_table"])
    block = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    # Block b meets the blocks j > b as (b, j), those below as (j, b), and itself as (b, b).
    dealt = every.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = cut(dealt.select("cluster", "by_table", F.col("rep").alias("doc_id"), "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    full = dealt.join(sets.select("doc_id", "shingles"), "doc_id")
    tasks = partitions_for(sets.sparkSession, dealt.count(), TASK_SETS)
    return full.repartition(tasks, "cluster", "by_table", "i", "j").sortWithinPartitions("cluster", "by_table", "i", "j", "doc_id").mapInArrow(_resolve(per_cent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, halves: int = 12, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct doc_id of docs(doc_id, text, ...).

    Texts are linked when 100 * intersection >= per_cent * union of their sets of `words`-word shingles (A-Z lowered,
    ASCII white space between words; the whole text as one shingle if it has fewer words). component_id is the
    smallest doc_id reachable over links, kept tells whether it is the document itself.

    Null or wordless texts have no shingles and are linked with nothing. Rows that repeat a doc_id are one document
    (with different texts it is linked by any of them, and takes the smallest component_id and the largest n_shingles).
    Rows without doc_id take part in nothing and give one row of nulls with kept true each. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_workers(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(source.mapInArrow(_signatures(words, halves, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    named = signed.filter("doc_id IS NOT NULL")
    texts = cut(named.filter("s1 IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    tables = cut(_tables(texts, halves))
    n = tables.count()
    met = cut(tables.select(F.col("rep").alias("doc_id")).distinct(), n)
    sets = cut(source.join(bounded_broadcast(met), "doc_id").mapInArrow(_with_sets(words), "doc_id long, n_shingles long, shingles binary").dropDuplicates(["doc_id", "shingles"]).filter("n_shingles > 0"))
    links = cut(_star_links(tables, n, sets, per_cent))
    linked = cut(connected_components(links), n)
    if (more := _block_links(tables, n, linked, sets, per_cent)) is not None:
        more = cut(more)
        linked = cut(connected_components(cut(links.unionByName(more), n + more.count())), n)

    member = named.join(texts.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    placed = member.join(bounded_broadcast(linked.select(F.col("node").alias("rep"), "component")), "rep", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    one = placed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    nameless = signed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return one.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose document is kept by near_duplicates(), one for each doc_id; rows without doc_id stay."""
    groups_of = near_duplicates(docs, **parameters)
    own, repeats = unused(docs, "_gone", "_many")
    gone = cut(groups_of.filter("NOT kept").select(F.col("doc_id").alias(own)))
    kept = docs.join(bounded_broadcast(gone), F.col("doc_id").cast("long") == F.col(own), "left_anti")
    many = cut(docs.select(F.col("doc_id").alias(repeats)).filter(F.col(repeats).isNotNull()).groupBy(repeats).agg(F.count("*").alias("n")).filter("n > 1").select(repeats))
    n = many.count()
    if not n:
        return kept
    repeated = F.col("doc_id") == F.col(repeats)
    return kept.join(bounded_broadcast(many, n), repeated, "left_anti").unionByName(kept.join(bounded_broadcast(many, n), repeated, "left_semi").dropDuplicates(["doc_id"]))
