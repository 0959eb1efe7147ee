"""Quality classifier on random Fourier features (operator 1).

A document becomes ``len(NAMES)`` statistics of its whole text. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; a ridge regression on them is fitted from
normal equations that every partition sums up on its own, and those sums are added up row by
row of the matrix, so the driver only ever holds one matrix of (FEATURES + 1) squared. Raw scores
are calibrated by isotonic regression over ``BINS`` equal-width bins of them, on labelled rows
kept out of the fit. Statistics, means and deviations come from all documents; the fit uses all
labelled training rows.

Neither label, language, source nor id is an input of a score. Null text counts as empty. Repeated
rows are scored alike; of several labels of an id the largest counts; null labels are none. With
no label to learn from, every score is ``PRIOR``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, SEED, WIDTH, RIDGE = 256, 20240, 4.0, 1e-3
BINS, PRIOR, CUT = 2000, 0.5, 0.3
NAMES = ("log_bytes", "upper", "digit", "symbol", "space", "non_ascii", "line_rate", "word_length", "distinct_words",
         "longest_word", "repeated_lines", "stop_rate", "symbol_words", "upper_words", "run_rate", "top_word")

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH, _WHITE = bytes(range(128, 256)), b" \t\n\r\x0b\x0c"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-\"()")


def statistics(text: str) -> list[float]:
    """The numbers a score is made of, all but the first between 0 and about 1."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    part = lambda chars: (n - len(raw.translate(None, chars))) / n
    words = raw.split()
    count = max(1, len(words))
    lower = [w.lower() for w in words]
    kinds: dict[bytes, int] = {}
    for w in lower:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    bare = [w for w in words if w.isalnum() or w.rstrip(b".,").isalnum()]
    codes = np.frombuffer(raw, np.uint8)
    return [
        float(np.log1p(n)) / 12, part(_UPPER), part(_DIGIT), part(_SYMBOL), part(_WHITE), part(_HIGH),
        min(1.0, len(lines) / count), min(1.0, n / count / 20), len(kinds) / count,
        min(1.0, max(map(len, words), default=0) / 60), 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / count, 1 - len(bare) / count, sum(w.isupper() for w in words) / count,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, max(kinds.values(), default=0) / count,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            stats = [statistics(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    return docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, stats array<double>")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def calibration_of(doc_id: Column) -> Column:
    """Whether a training row is kept for the calibration: one in four, by another hash."""
    return F.pmod(F.xxhash64(doc_id), F.lit(4)) == 0


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(stats), PRIOR)
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray) -> np.ndarray:
    """cos(w x + b) for FEATURES random directions of a Gaussian kernel, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _normal_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_stats(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([x.tobytes() for x in total], pa.binary())],
                                         names=["line", "sums"])

    return rows


def _added(batches: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, float) for x in batches["sums"].to_pylist())
    return pa.table({"line": batches["line"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to ``y`` weighted by ``n``, in the order given."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.concatenate([np.full(int(k), s / w) for s, w, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats``: doc_id and stats of all documents. ``labels``: doc_id, label of the rows to learn from."""
    spread = [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = stats.agg(*spread).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(NAMES))])
    scale = np.array([max(row[f"s{i}"] or 0.0, 1e-6) for i in range(len(NAMES))])
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.join(known, "doc_id").select("doc_id", "stats", F.col("label").cast("double").alias("label"))
    held = calibration_of(F.col("doc_id"))
    partial = rows.filter(~held).select("stats", "label").mapInArrow(_normal_rows(model), "line int, sums binary")
    lines = {r["line"]: np.frombuffer(r["sums"], float) for r in partial.groupBy("line").applyInArrow(_added, "line int, sums binary").collect()}
    if len(lines) <= FEATURES:
        return model
    system = np.array([lines[i] for i in range(FEATURES + 1)])
    gram, target = system[:, :-1], system[:, -1]
    seen = gram[-1, -1]
    if not seen:
        return model
    weights = np.linalg.solve(gram + RIDGE * seen / FEATURES * np.eye(FEATURES + 1), target)
    model = Model(mean, scale, weights, np.zeros(0), np.zeros(0))
    binned = rows.filter(held).select("stats", "label").mapInArrow(_binned(model), "bin int, label double")
    bins = sorted(tuple(r) for r in binned.groupBy("bin").agg(F.avg("label"), F.count(F.lit(1))).collect())
    if not bins:
        bins = [(0, target[-1] / seen, seen)]
    at, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    return Model(mean, scale, weights, (at + 0.5) / BINS * 3 - 1, isotonic(at, y, n))


def _binned(model: Model):
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (np.clip(model.raw(_stats(batch)), -1, 2) + 1) / 3 * BINS
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(raw, BINS - 1).astype(np.int32)), batch.column("label")], names=["bin", "label"])

    return bins


def _scored(model: Model):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch)))], names=["doc_id", "score"])

    return scores


def apply(model: Model, stats: DataFrame) -> DataFrame:
    """doc_id and score, a row for each row of ``stats``."""
    return stats.select("doc_id", "stats").mapInArrow(_scored(model), "doc_id long, score double")
