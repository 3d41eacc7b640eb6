"""Text quality by a naive Bayes support vector machine.

Indicators of byte n-grams are scaled by the log ratio of their smoothed frequencies in the two classes; a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent on the driver, over a bounded sample of
the labelled rows (SAMPLE_ROWS and SAMPLE_FEATURES, the least hashes of doc_id, so that the sample does not depend on
order or partitions). Margins become probabilities by Platt's scaling. Scoring reads every text whole, in one pass, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytewords as bw
from quillspark.llm.frames import cut, python_workers

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 4_000
#: Indicators that these rows have at most, all together (4 bytes each on the driver): rows beyond are not fitted on.
SAMPLE_FEATURES = 40_000_000
#: Indicators that are fetched from a partition of the sample, at most, but for a longer text's.
FETCHED_FEATURES = 4_000_000
#: Hashed features.
FEATURES = 1 << 18
#: Lengths of the byte n-grams.
ORDERS = (1, 2, 3, 4)
#: Indicators of n-grams of one word repeated: a word stands at least so many times in a row.
REPEATS = (2, 3, 4, 6, 8, 12, 16, 32)


class Indicators:
    """The distinct hashed n-grams of a text, by a table of flags."""

    def __init__(self) -> None:
        self.seen = np.zeros(FEATURES + len(REPEATS), bool)
        self.multipliers = (bw.seeds(max(ORDERS), 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Sorted feature numbers of each text; none for an empty text."""
        data, offsets = bw.column_bytes(column)
        for a, b in bw.blocks(offsets):
            words = bw.Words(data, offsets, a, b, bw.SPACE)
            for k in range(a, b):
                yield self._one(data[offsets[k] : offsets[k + 1]], words.hash[words.first[k - a] : words.first[k - a + 1]])

    def _one(self, text: np.ndarray, words: np.ndarray) -> np.ndarray:
        changes = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]])) if len(words) else np.zeros(1, np.int64)
        run = int(np.diff(changes).max(initial=0))
        for k, least in enumerate(REPEATS):
            self.seen[FEATURES + k] = run >= least
        shift = np.uint32(32 - (FEATURES - 1).bit_length())
        with np.errstate(over="ignore"):
            for a in range(0, len(text), 1 << 16):  # the n-grams that begin in this part, whole
                part = text[a : a + (1 << 16) + max(ORDERS) - 1].astype(np.uint32)
                h = np.zeros(len(part), np.uint32)
                for k, n in enumerate(range(1, max(ORDERS) + 1)):
                    if len(part) < n:
                        break
                    h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint32(1)) * self.multipliers[k]
                    if n in ORDERS:
                        self.seen[(h[: 1 << 16] ^ (h[: 1 << 16] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


@dataclass(frozen=True)
class QualityModel:
    """weights of the indicators, bias, and Platt's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        margin = self.weights[features].sum(dtype=np.float64) / np.sqrt(len(features)) + self.bias if len(features) else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


@dataclass(frozen=True)
class Rows:
    """Feature lists one after the other (compressed sparse rows): row k is features[ends[k]:ends[k + 1]]."""

    features: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        return cls(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), np.cumsum([0, *(len(x) for x in lists)]))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        return self.features[self.ends[k] : self.ends[k + 1]]


def fit_nbsvm(rows: Rows, labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20) -> QualityModel:
    """Fit to feature lists and labels (0 or 1). With one class only, every score is that class's smoothed frequency.

    The objective is half the squared length of the weights of the scaled indicators, bias included, and the hinge
    losses, weighed by cost and so that either class has half of the weight.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    good, bad = np.full(FEATURES + len(REPEATS), smoothing), np.full(FEATURES + len(REPEATS), smoothing)
    for k, c in enumerate(y):
        (good if c > 0 else bad)[rows[k]] += 1
    n_good, n_bad = int((y > 0).sum()), int((y < 0).sum())
    prior = np.log((n_good + 1) / (n_bad + 1))
    if not n_good or not n_bad:
        return QualityModel(np.zeros(FEATURES + len(REPEATS)), 0.0, 1.0, float(prior))
    ratio = np.log(good / (n_good + 2 * smoothing)) - np.log(bad / (n_bad + 2 * smoothing))

    # Dual coordinate descent (hinge loss); classes weigh the same in all; the bias is a feature that is always 1.
    # Scaled features are computed anew at each step: keeping them would take twice the memory of the sample.
    square = np.array([(ratio[x] ** 2).sum() / max(1, len(x)) + 1 for x in (rows[k] for k in range(len(rows)))])
    most = cost * np.where(y > 0, len(y) / (2 * n_good), len(y) / (2 * n_bad))
    w, bias, alpha = np.zeros(FEATURES + len(REPEATS)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    active = np.arange(len(y))
    for _ in range(epochs):
        rng.shuffle(active)
        worst = 0.0
        for i in active:
            x = rows[i]
            s = ratio[x] / np.sqrt(max(1, len(x)))
            gradient = y[i] * (w[x] @ s + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                alpha[i] = new
                w[x] += step * s
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    weights = w * ratio
    margins = np.array([weights[x].sum() / np.sqrt(max(1, len(x))) for x in (rows[k] for k in range(len(rows)))]) + bias

    # Platt's scaling by Newton steps, with his smoothed targets.
    target = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    slope, offset = 1.0, float(prior)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([(d * margins).sum(), d.sum()])
        hessian = np.array([[(v * margins**2).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, g)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return QualityModel(weights, float(bias), float(slope), float(offset))


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> QualityModel:
    """A model from docs(doc_id, text) and labels(doc_id, quality 0/1). Other labels, nulls and other columns are ignored.

    Give only the rows of labels that may be learned from. Of labelled documents, those with the least hashes of doc_id
    are fetched as feature lists: at most sample_rows, and only as long as they can have sample_features in all (at
    least one). Of rows that repeat a doc_id, the least text counts and the least label; a null text is empty.
    """
    spark = docs.sparkSession
    python_workers(spark)
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")))
    # A byte begins one n-gram of each length at most.
    most = F.least(F.coalesce(F.octet_length("text"), F.lit(0)) * len(ORDERS), F.lit(FEATURES)) + len(REPEATS)
    used, sizes = 0, rows.select("doc_id", most.cast("long").alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    kept = []
    for doc_id, n in zip(sizes.column("doc_id").to_pylist(), sizes.column("n").to_pylist(), strict=True):
        used += n
        if kept and used > sample_features:
            break
        kept.append((doc_id,))
    rows = rows.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Indicators()
        for batch in batches:
            found = [x.astype(np.int32).tobytes() for x in features.of_column(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "features"])

    ordered = rows.repartitionByRange(max(1, -(-used // FETCHED_FEATURES)), "doc_id").sortWithinPartitions("doc_id")
    return fit_nbsvm(*_in_one_array(ordered.select("label", "text").mapInArrow(run, "label int, features binary"), used))


def _in_one_array(sample: DataFrame, most: int) -> tuple[Rows, np.ndarray]:
    """Rows and labels of (label, features) of at most so many features, in the order of its partitions.

    They are fetched a partition at a time, so the driver holds the array and one partition beside it.
    """
    features, ends, labels = np.empty(most, np.int32), [0], []
    for row in sample.toLocalIterator(prefetchPartitions=True):
        own = np.frombuffer(row["features"], np.int32)
        features[ends[-1] : ends[-1] + len(own)] = own
        ends.append(ends[-1] + len(own))
        labels.append(row["label"])
    return Rows(features[: ends[-1]], np.array(ends, np.int64)), np.array(labels, np.int64)


def score_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs(text, ...) with the probability of quality 1 added as `column` (one of this name is replaced).

    Null and empty texts get the bias's score. Repeated rows score alike; no rows give none.
    """
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(QualityModel(model.weights.astype(np.float32), model.bias, model.slope, model.offset))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        features, own = Indicators(), shared.value
        return pa.array([own.score(x) for x in features.of_column(texts)], pa.float64())

    return docs.withColumn(column, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
