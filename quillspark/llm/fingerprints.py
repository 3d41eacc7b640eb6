"""Document fingerprints by consistent weighted sampling.

For every word of a text and every one of SAMPLES hash functions there are fixed gamma-distributed values; the word
and level with the least of a function of them and the word's count is that function's sample. Two texts have the
same sample with a probability of their generalised Jaccard similarity, sum of minima over sum of maxima of counts.
Gamma(2, 1) values are sums of two exponential ones, drawn from two tables by two hashes of the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytewords as bw
from quillspark.llm.frames import partitions_for, python_workers

#: Samples in a fingerprint; each is four hexadecimal digits.
SAMPLES = 64
_ROWS = 4096
#: Documents of a block that is sorted in one task, and the most blocks (8 bytes each in a broadcast).
BLOCK_DOCS, MOST_BLOCKS = 2000, 100_000
#: Numbers that the driver gets to cut the rows of ids that very many rows have.
TEXT_CUTS = 1_000_000


class Sampler:
    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.exponential = [rng.standard_exponential((_ROWS, SAMPLES), np.float32) for _ in range(4)]
        self.uniform = [rng.random((_ROWS, SAMPLES), np.float32) for _ in range(2)]

    def _tables(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (words & np.uint64(_ROWS - 1)).astype(np.intp), ((words >> np.uint64(20)) & np.uint64(_ROWS - 1)).astype(np.intp)
        r = self.exponential[0][i] + self.exponential[1][j] + np.float32(1e-6)
        c = np.log(self.exponential[2][i] + self.exponential[3][j] + np.float32(1e-12))
        beta = self.uniform[0][i] + self.uniform[1][j]
        return r, c, beta - np.floor(beta)

    def samples(self, words: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
        """For each vector of counts of the distinct words, SAMPLES 16-bit values; zeros if it has none."""
        best = [np.full(SAMPLES, np.inf, np.float32) for _ in counts]
        value = [np.zeros(SAMPLES, np.uint64) for _ in counts]
        for a in range(0, len(words), 1024):
            part = words[a : a + 1024]
            r, c, beta = self._tables(part)
            for k, own in enumerate(counts):
                w = own[a : a + 1024]
                if not w.any():
                    continue
                weight = np.full(len(w), -np.inf, np.float32)
                np.log(w, out=weight, where=w > 0)
                there = w > 0
                level = np.floor(np.where(there, weight, np.float32(0))[:, None] / r + beta)
                score = np.where(there[:, None], c - r * (level - beta + 1), np.float32(np.inf))
                at = score.argmin(axis=0)
                columns = np.arange(SAMPLES)
                less = score[at, columns] < best[k]
                best[k] = np.where(less, score[at, columns], best[k])
                with np.errstate(over="ignore"):
                    name = bw._mix(part[at] + level[at, columns].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                value[k] = np.where(less, name, value[k])
        return [(v >> np.uint64(48)).astype(">u2") for v in value]


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words, sorted, and how often they occur, for each text."""
    data, offsets = bw.column_bytes(pa.array(texts, pa.large_string()))
    out = []
    for a, b in bw.blocks(offsets):
        w = bw.Words(data, offsets, a, b, bw.SPACE)
        out += [np.unique(w.hash[w.first[k] : w.first[k + 1]], return_counts=True) for k in range(b - a)]
    return out


_sampler: list[Sampler] = []


def _sampler_here() -> Sampler:
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def fingerprint(texts: list[str]) -> list[str]:
    """Fingerprints of texts, as hexadecimal strings."""
    sampler = _sampler_here()
    return [sampler.samples(w, [n])[0].tobytes().hex() for w, n in _counts(texts)]


def likeness(a: str, b: str) -> float:
    """The share of samples that two fingerprints have in common."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points from the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class Blocks:
    """Consecutive blocks of rows in the order of (id, order of the text): cut at ids, and some ids' own rows at texts."""

    def __init__(self, cuts: np.ndarray, text_cuts: dict[int, np.ndarray]) -> None:
        self.cuts, self.text_cuts = cuts, text_cuts
        own = np.array([0] + [len(text_cuts[c]) + 1 if c in text_cuts else 0 for c in cuts.tolist()])
        # The block that begins at a cut has its id's own parts first, and then one for the ids that follow.
        self.start = np.arange(len(own)) + np.cumsum(own) - own
        self.rest = (self.start + own).astype(np.int32)
        self.number = int(self.rest[-1]) + 1

    def of(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.cuts, at, "right")
        out = self.rest[k]
        for c, inner in self.text_cuts.items():
            if (own := at == c).any():
                out[own] = self.start[np.searchsorted(self.cuts, c, "right")] + np.searchsorted(inner, v[own], "right")
        return out


def _text_order(text: Column) -> Column:
    """A number that puts texts in order of their first four bytes, then of a hash."""
    first = F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 4)), 8, "0"), 16, 10).cast("long")
    return first * (1 << 31) + F.pmod(F.xxhash64(text), F.lit(1 << 31))


def _text_cuts(places: DataFrame, hot: dict[int, int]) -> dict[int, np.ndarray]:
    """Quantiles of v among the rows of each hot id of places(at, v), as many as the id is to have blocks; TEXT_CUTS numbers in all, about."""
    if not hot:
        return {}
    shares = min(max(hot.values()), max(256, TEXT_CUTS // len(hot)))
    own = places.join(F.broadcast(places.sparkSession.createDataFrame([(c,) for c in hot], "at long")), "at", "left_semi")
    found = own.groupBy("at").agg(F.percentile_approx("v", [j / shares for j in range(1, shares)], max(10_000, 4 * shares)).alias("q")).collect()
    return {r["at"]: np.unique(np.array(r["q"], np.int64)[:: max(1, shares // hot[r["at"]])]) for r in found}


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text takes its last quarter from the next document in the order of doc_id (then the text's first bytes,
    then a hash of it; the first document again after the last). Fingerprints count words between ASCII white space,
    A-Z lowered. Null texts count as empty; an empty text's fingerprint is all zeros, like another empty text's. Rows
    without doc_id come first. Repeated rows follow each other. A single row follows itself. Other columns are ignored;
    no rows give none.

    Ids are cut into blocks at quantiles; a block's texts are sorted in one task, and a copy of each block's first
    text goes to the block before it. So every text is shuffled once, and no task sees all rows. The rows of an id that
    has several blocks' worth of them (or of none, if many rows lack one) are cut further in the order of their texts;
    only equal rows stay together.
    """
    spark = docs.sparkSession
    python_workers(spark)
    lowest = -(2**63)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at, text_at = F.coalesce("doc_id", F.lit(lowest)).alias("at"), _text_order(F.col("text"))
    ids = source.select(at)
    n_docs = ids.count()
    n = max(1, min(MOST_BLOCKS, n_docs // BLOCK_DOCS))
    found = ids.agg(F.percentile_approx("at", [k / n for k in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("q")).first()["q"]
    cuts, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    hot = {int(c): int(m) for c, m in zip(cuts, times, strict=True) if m > 1}  # these ids are several quantiles
    here = spark.sparkContext.broadcast(Blocks(cuts, _text_cuts(source.select(at, text_at.alias("v")), hot)))

    @F.arrow_udf("int")
    def block_of(at: pa.Array, v: pa.Array) -> pa.Array:
        return pa.array(here.value.of(at.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)))

    places = source.select(at, (text_at if hot else F.lit(0).cast("long")).alias("v"))  # texts are read for hot ids only
    firsts = {r["block"]: r["first"] for r in places.select(block_of("at", "v").alias("block"), F.struct("at", "v").alias("x")).groupBy("block").agg(F.min("x").alias("first")).collect()}  # one row a block
    order = sorted(firsts)
    # The first text of a block closes the block before it; that of the first block closes the last.
    closes, first_at, first_v = np.full(here.value.number, -1, np.int32), np.full(here.value.number, lowest, np.int64), np.zeros(here.value.number, np.int64)
    for k, block in enumerate(order):
        closes[block], first_at[block], first_v[block] = order[k - 1], firsts[block]["at"], firsts[block]["v"]
    state = spark.sparkContext.broadcast((closes, first_at, first_v))

    @F.arrow_udf("array<int>")
    def targets(at: pa.Array, v: pa.Array) -> pa.Array:
        close, first, least = state.value
        at, v = at.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
        block = here.value.of(at, v)
        closing = at == first[block]
        if hot:  # of equal rows, one of a batch is enough
            closing &= v == least[block]
            one = np.zeros(len(at), bool)
            one[np.flatnonzero(closing)[np.unique(block[closing], return_index=True)[1]]] = True
            closing = one
        return pa.array([[b, close[b]] if c else [b] for b, c in zip(block.tolist(), closing.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = source.select("doc_id", "text", at, text_at.alias("v")).withColumn("targets", targets("at", "v"))
    dealt = dealt.select("doc_id", "text", "at", "v", F.posexplode("targets").alias("closing", "block"))
    parts = partitions_for(spark, n_docs, 5 * BLOCK_DOCS)
    ordered = dealt.repartition(parts, "block").sortWithinPartitions("block", "closing", "at", "v", "text").select("block", "closing", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler_here()
        held: tuple | None = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("block", "closing", "doc_id", "text")), strict=True))
            pairs = []
            for row in rows:
                if held is not None and held[0] == row[0] and not held[1]:
                    pairs.append((held[2], held[3], row[3]))
                held = row
            for a in range(0, len(pairs), 64):
                yield _compared(sampler, pairs[a : a + 64])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(sampler: Sampler, pairs: list[tuple]) -> pa.RecordBatch:
    ids = [p[0] for p in pairs]
    own, following = [p[1] for p in pairs], [p[2] for p in pairs]
    changed = [edited(x, y) for x, y in zip(own, following, strict=True)]
    # Consecutive pairs share a text: the next document of one is the next one's own.
    last = [k for k in range(len(pairs)) if k == len(pairs) - 1 or own[k + 1] is not following[k]]
    counts, counts_changed = _counts(own), _counts(changed)
    prints, prints_changed = [], []
    for (w, n), (v, m) in zip(counts, counts_changed, strict=True):
        words = np.union1d(w, v)
        both = [np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)]
        both[0][np.searchsorted(words, w)] = n
        both[1][np.searchsorted(words, v)] = m
        a, b = sampler.samples(words, both)
        prints.append(a)
        prints_changed.append(b)
    ends = dict(zip(last, [sampler.samples(w, [n])[0] for w, n in _counts([following[k] for k in last])], strict=True))
    after = [ends[k] if k in ends else prints[k + 1] for k in range(len(pairs))]
    near = [(float((a == b).mean()), float((a == c).mean())) for a, b, c in zip(prints, prints_changed, after, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(changed, pa.string()), pa.array([p.tobytes().hex() for p in prints]), pa.array([p.tobytes().hex() for p in prints_changed]), pa.array([x for x, _ in near]), pa.array([x for _, x in near])],
        ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
