"""Exact nearest neighbours, centroids and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import l2_normalize
from quillspark.functions.workers import ship_package

#: Rows of a tile: each task of a search holds one tile of queries and one of vectors.
TILE_ROWS = 8192
#: Query vectors whose distances to a tile are held at once.
QUERY_ROWS = 256
#: Powers of two beyond which squares would leave the range of doubles, so that vectors are scaled first.
SAFE_EXPONENT = 400


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", drop_self: bool = False, tile: int = TILE_ROWS) -> DataFrame:
    """(query_id, id, distance, similarity, rank): the k nearest of vectors(id, embedding) to queries(query_id, embedding).

    Exact, as a tiled product: both sides are dealt into tiles of some `tile` rows by a hash of their ids, each pair of
    tiles meets in one task, and the k best of each query there are merged by a window that keeps k of each task before
    it shuffles. No vector passes the driver, nothing is broadcast, and a task's memory does not depend on the number of
    rows of either side. l2: similarity is 1 - distance / 2; cosine: distance is 1 - cosine and similarity
    1 - distance / 2. Ids are of any type that sorts (of one type on both sides with drop_self); ties go by id. Vectors that are null or
    hold nulls and queries without id take no part; queries only meet vectors of their length.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"metric: {metric}")
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    own = queries.filter(whole & F.col("query_id").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    rows = vectors.filter(whole).select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    n_own, n_rows = (max(1, -(-df.count() // tile)) for df in (own, rows))
    own = own.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(n_own))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_own - 1)).cast("array<long>")))
    best = tiles(own, rows, ["dim", "a", "b"], k, metric, drop_self, digits=9)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return best.withColumn("similarity", 1 - F.col("distance") / 2).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tiles(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, metric: str = "l2", drop_self: bool = False, digits: int | None = None, slots: str | None = None) -> DataFrame:
    """(query_id, id, distance): the k best rows(id, embedding) of each of queries(query_id, embedding) with the same keys.

    Each group of equal keys is held by one task and must be bounded on both sides; its vectors have one length.
    slots names an array column of the queries and a column of the rows, if a query is only to meet rows whose value is
    in its array. Distances are ordered as they are, or rounded to so many digits; ties go by id.
    """
    ship_package(rows.sparkSession)
    types = dict(queries.dtypes), dict(rows.dtypes)
    schema = f"query_id {types[0]['query_id']}, id {types[1]['id']}, distance double"

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        asked, given = own["query_id"].combine_chunks(), others["id"].combine_chunks()
        if not len(asked) or not len(given):
            return pa.table({"query_id": asked[:0], "id": given[:0], "distance": pa.array([], pa.float64())})
        # Codes that sort as the ids do; where a row's own query is left out, equal ids on both sides have one code.
        shared = [asked.to_numpy(False)] if drop_self else []
        codes = np.unique(np.concatenate([*shared, given.to_numpy(False)]), return_inverse=True)[1]
        q_codes, v_codes = codes[: len(codes) - len(given)], codes[len(codes) - len(given) :]
        allowed = None
        if slots is not None:
            held = own[slots].combine_chunks()
            allowed = np.zeros((len(asked), 1 + max(held.flatten().to_numpy().max(initial=0), (at := others[slots].to_numpy()).max())), bool)
            allowed[np.repeat(np.arange(len(asked)), held.value_lengths().to_numpy()), held.flatten().to_numpy()] = True
            allowed = allowed[:, at]
        i, j, distance = nearest(_matrix(own["embedding"]), _matrix(others["embedding"]), q_codes, v_codes, k, metric, drop_self, digits, allowed)
        return pa.table({"query_id": asked.take(pa.array(i)), "id": given.take(pa.array(j)), "distance": distance})

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(False).reshape(len(column), -1)


def nearest(q: np.ndarray, v: np.ndarray, q_codes: np.ndarray, v_codes: np.ndarray, k: int, metric: str = "l2", drop_self: bool = False, digits: int | None = None, allowed: np.ndarray | None = None):
    """Indexes into q and v and distances of the k nearest of v to each of q, best first; ties go by code.

    One matrix product finds what may be among the k best; distances of these are computed as they are defined.
    allowed[i, j] tells whether q[i] may meet v[j].
    """
    scale = np.frexp(max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)))[1]
    scale = scale if abs(scale) > SAFE_EXPONENT else 0
    q, v = np.ldexp(q, -scale), np.ldexp(v, -scale)
    v_square, out = (v**2).sum(axis=1), []
    for a in range(0, len(q), QUERY_ROWS):
        part = q[a : a + QUERY_ROWS]
        dots, q_square = part @ v.T, (part**2).sum(axis=1)
        if metric == "l2":
            rough = np.maximum(q_square[:, None] + v_square[None, :] - 2 * dots, 0)
            slack = 1e-9 * (q_square[:, None] + v_square.max()) + 1e-12 * v_square.max()
        else:
            rough = 1 - dots / np.maximum(np.sqrt(q_square)[:, None] * np.sqrt(v_square)[None, :], 1e-300)
            slack = np.full((len(part), 1), 2e-9)
        if drop_self:
            rough[q_codes[a : a + QUERY_ROWS, None] == v_codes[None, :]] = np.inf
        if allowed is not None:
            rough[~allowed[a : a + QUERY_ROWS]] = np.inf
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < len(v) else np.full((len(part), 1), np.inf)
        i, j = np.nonzero((rough <= edge + slack) & np.isfinite(rough))
        exact = np.ldexp(np.sqrt(((v[j] - part[i]) ** 2).sum(axis=1)), scale) if metric == "l2" else rough[i, j]
        order = np.lexsort((v_codes[j], exact if digits is None else exact.round(digits), i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[best] + a, j[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(group, embedding): the mean of each group's vectors, of length 1 unless it is zero. Means combine before the shuffle."""
    parts = vectors.filter(F.col(group).isNotNull()).select(group, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(group, l2_normalize("mean").alias("embedding"))


def related(groups: DataFrame, group: str, k: int) -> DataFrame:
    """(source, group, similarity, rank): the k groups with the nearest centroids to each group's, itself excluded; by knn(). Ties go by group."""
    own = groups.select(F.col(group).alias("id"), "embedding")
    near = knn(own.withColumnRenamed("id", "query_id"), own, k, drop_self=True)
    return near.select(F.col("query_id").alias("source"), F.col("id").alias(group), "similarity", "rank")


def passage_text(title: str = "title", section: str = "section", text: str = "text"):
    """What is embedded of a chunk: its title and section, then its text."""
    head = F.when((F.col(title) != "") & (F.col(section) != ""), F.concat_ws(" — ", title, section)).when(F.col(title) != "", F.col(title))
    return F.when(head.isNotNull(), F.concat(F.lit("passage: "), head, F.lit("\n\n"), F.col(text))).otherwise(F.concat(F.lit("passage: "), F.col(text)))


def hashing_embedder(dimensions: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder: words add hashed signs, rows have length 1. It needs no model."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dimensions] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return embed


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """rows with embedding added, batch by batch; any function from texts to a matrix will do."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(series: pd.Series) -> pd.Series:
        texts = series.fillna("").tolist()
        parts = [embedder(texts[a : a + batch]) for a in range(0, len(texts), batch)]
        return pd.Series([v.tolist() for p in parts for v in p])

    return rows.withColumn("embedding", run(F.col(text)))
