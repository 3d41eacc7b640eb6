"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its own, so that K + K centroids make K * K
cells. A query walks over pairs of centroids by the sum of their two squared distances, with a heap, until the cells it
has passed hold enough entries; these are ranked by their exact distances.

Entries of a first centroid are dealt into blocks of bounded size by a hash of their ids, queries into tiles; each block
meets each tile once, with the cells that each query visits, and sends on the k best of each query only. No pair of
query and entry is ever a row. What the driver sees is the codebooks' bounded sample and one count for each cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import frames
from quillspark.operators.vectors import tiles

#: Centroids of a half.
CENTROIDS = 32
#: Vectors that the codebooks are fitted on, about; twice as many at most. All vectors are indexed.
SAMPLE_ROWS = 8192
#: Rounds of Lloyd's algorithm.
ROUNDS = 20
#: Share of all entries that a query visits, and the least number of entries it visits. With 64 nearly independent
#: dimensions and 32 centroids, half the entries hold some 94 % of the ten nearest.
SHARE, LEAST = 0.6, 2000
#: Entries of a block and queries of a tile, on average.
BLOCK_ROWS, TILE_QUERIES = 4096, 2048


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the two halves of vectors of one length."""

    length: int
    first: np.ndarray
    second: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of each vector to the centroids, less a constant for each half."""
        cut = self.length // 2
        return tuple((c**2).sum(axis=1)[None, :] - 2 * (x @ c.T) for x, c in ((vectors[:, :cut], self.first), (vectors[:, cut:], self.second)))


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, as doubles.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    those of another length than most have (of the longer, if two lengths are as frequent). Repeated rows are entries
    of their own. Other columns are not looked at.
    """
    x = F.col(vector)
    fit = F.col(id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col(id).cast("long").alias("id"), x.cast("array<double>").alias("vector"))
    most = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.filter(F.size("vector") == (most[0]["length"] if most else 0))


def fit_codebooks(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable() rows, fitted on a bounded sample of them chosen by a hash of the ids; None without rows."""
    n = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).toArrow()
    if not chosen.num_rows:
        chosen = rows.limit(sample).toArrow()
    if not chosen.num_rows:
        return None
    # A stable order, whatever order the rows arrived in.
    matrix = chosen["vector"].combine_chunks().flatten().to_numpy(False).reshape(chosen.num_rows, -1)
    matrix = matrix[np.lexsort(matrix.T[::-1])]
    cut = matrix.shape[1] // 2
    return Codebooks(matrix.shape[1], _lloyd(matrix[:, :cut], centroids, rounds), _lloyd(matrix[:, cut:], centroids, rounds))


def _lloyd(points: np.ndarray, centroids: int, rounds: int) -> np.ndarray:
    """Centroids by Lloyd's algorithm from distinct points; a centroid that loses all its points stays where it is."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(0).permutation(len(distinct))[:centroids]]
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1)[None, :] - 2 * (points @ centres.T)).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def build_index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, vector, first, second): each row of usable() with the centroids of its halves, as a checkpoint."""
    frames.python_workers(rows.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = batch["vector"].flatten().to_numpy(False).reshape(batch.num_rows, -1)
                first, second = (d.argmin(axis=1).astype(np.int32) for d in books.distances(matrix))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array(first), pa.array(second)], ["id", "vector", "first", "second"])

    return frames.cut(rows.select("id", "vector").mapInArrow(encode, "id long, vector array<double>, first int, second int"))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids by the sum of their distances, until the cells passed hold enough entries (or no cell is left).

    A pair is put on the heap once both its neighbours nearer to the query have been passed, so the heap has at most as
    many pairs as a codebook has centroids.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, cells = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    reached = [0] * len(x)  # how many of the second centroids have been passed with each of the first
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        if cells[i][j]:
            out.append((int(a[i]), int(b[j])))
            held += cells[i][j]
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def search_index(index: DataFrame, books: Codebooks, queries: DataFrame, k: int, share: float = SHARE, least: int = LEAST, block: int = BLOCK_ROWS, tile: int = TILE_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest entries found of each of queries(query_id, vector), but its own id's.

    score is the Euclidean distance of the vectors as given; equal ones rank by id. A query visits cells until they hold
    share of all entries, and at least so many beside its own; with share 1 all are visited and the result is exact.
    Queries with one id and different vectors are taken as one, by the least vector.
    """
    cells = index.groupBy("first", "second").count().collect()  # one row for each cell at most
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for c in cells:
        counts[c["first"], c["second"]] = c["count"]
    total = int(counts.sum())
    enough = min(total, max(int(np.ceil(share * total)), least + 1))
    own = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch["vector"].flatten().to_numpy(False).reshape(batch.num_rows, -1)
            rows, firsts, slots = [], [], []
            for row, (x, y) in enumerate(zip(*books.distances(matrix), strict=True)):
                by_first: dict[int, list[int]] = {}
                for i, j in walk(x, y, counts, enough):
                    by_first.setdefault(i, []).append(j)
                rows += [row] * len(by_first)
                firsts += by_first.keys()
                slots += by_first.values()
            at = pa.array(rows, pa.int64())
            arrays = [batch["query_id"].take(at), batch["vector"].take(at), pa.array(firsts, pa.int32()), pa.array(slots, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "embedding", "first", "second"])

    visited = own.mapInArrow(visits, "query_id long, embedding array<double>, first int, second array<int>")
    # A first centroid with many entries has as many blocks; their numbers are bounded by the codebook.
    spark = index.sparkSession
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in counts.sum(axis=1)]), F.col("first") + 1)
    n_tiles = max(1, -(-own.count() // tile))
    spread = visited.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(n_tiles))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1).cast("array<long>")))
    entries = index.select("id", F.col("vector").alias("embedding"), "first", "second", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    entries = entries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)).cast("array<long>")))
    frames.python_workers(spark)
    best = tiles(spread, entries, ["first", "block", "tile"], k, drop_self=True, slots="second")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", F.col("distance").alias("score"))


def neighbours(vectors: DataFrame, every: int, k: int, id: str = "vec_id", vector: str = "embedding", share: float = SHARE, least: int = LEAST, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, id, score) of search_index() for the usable() rows whose id is divisible by every, over all usable rows.

    No usable rows give no result. A single row has no neighbours and gives none.
    """
    rows = usable(vectors, id, vector)
    books = fit_codebooks(rows, centroids)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    index = build_index(rows, books)
    queries = index.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")
    return search_index(index, books, queries, k, share, least)
