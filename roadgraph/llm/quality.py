"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to random cosines, whose inner product approximates a
Gaussian kernel. Every partition sums its share of the normal equations; the sums are added in Spark and the
driver solves one system whose size is the number of features. A second fold of the training rows calibrates
the raw scores: counts per score bin, then pool-adjacent-violators over the bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, id_crc, small_batches, stored, table

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "lower", "digits", "blanks", "points", "symbols", "bars",
    "high", "symbol_ends", "distinct_words", "log_distinct_words", "line_chars", "distinct_lines", "capitals", "long_words",
)
FEATURES = 256
RIDGE = 1e-3
SEED = 77
BINS = 400
#: Labelled rows that the model is fitted on, drawn by hash from all of them.
MAX_TRAIN = 40_000
THRESHOLD = 0.3

# classes of bytes: 0 other control, 1 upper, 2 lower, 3 digit, 4 blank, 5 points, 6 symbols, 7 bar, 8 not ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[_c] = 6
_CLASS[124] = 7


def statistics(text: str) -> list[float]:
    """STATISTICS of one text; zeros for an empty one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = _CLASS[data]
    share = np.bincount(kinds, minlength=9) / n
    words = text.split()
    w = len(words)
    lines = text.split("\n")
    ends = float(((kinds[:-1] >= 6) & (kinds[:-1] <= 7) & (kinds[1:] == 4)).sum()) / max(1, w)
    capitals = float(((kinds[:-1] == 1) & (kinds[1:] == 1)).sum()) / n
    distinct = len(set(words))
    return [
        np.log1p(n), np.log1p(w), len(text) / max(1, w), share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        share[8], ends, distinct / max(1, w), np.log1p(distinct) / np.log1p(max(1, w)), np.log1p(n / len(lines)),
        len(set(lines)) / len(lines), capitals, sum(map(_long, words)) / max(1, w),
    ]


def _long(word: str) -> bool:
    return len(word) > 20


@dataclass(frozen=True)
class Model:
    """Everything a task needs to score a text; a few hundred kB at most."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    bins: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return _waves((x - self.mean) / self.scale, self.waves, self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.bins, self.level), 0, 1)


def _waves(z: np.ndarray, waves: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([np.sqrt(2 / waves.shape[1]) * np.cos(z @ waves + phase), np.ones((len(z), 1))])


def _stack(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(x or "") for x in texts], np.float64).reshape(-1, len(STATISTICS))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(list(map(list, _stack(b.column(2).to_pylist()))), pa.list_(pa.float64()))], names=["u", "y", "x"]
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing means of good/total by pool-adjacent-violators; every total is positive."""
    blocks: list[list[float]] = []
    for n, g in zip(total, good, strict=True):
        blocks.append([float(n), float(g), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, g2, k2 = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += g2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), g / n) for n, g, k in blocks])


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on documents with a label 0 or 1 (column quality), about max_train of them. None if there is no such document.

    Labels are drawn by a hash of their id. Null texts count as empty, null ids match no label; a document that
    repeats an id, or a label that does, counts once for every pair of them.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("y")).filter("label_id is not null and y in (0, 1)")
    n = marks.count()
    if n > max_train:
        marks = marks.filter(drawn(F.xxhash64("label_id"), max_train, n))
    # the sample has at most about max_train rows of two numbers
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), F.col("id") == F.col("label_id"))
    data = stored(own.select(F.xxhash64("id").alias("u"), "y", "text").mapInArrow(_statistics, "u long, y double, x array<double>"), "quality-train").coalesce(8)
    k = len(STATISTICS)
    s = data.agg(F.count(F.lit(1)), *(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(k))).first()
    if not s[0]:
        return None
    mean, scale = np.array(s[1 : k + 1]), np.maximum(np.array(s[k + 1 :]), 1e-6)
    rng = np.random.Generator(np.random.PCG64(SEED))
    waves, phase = rng.standard_normal((k, FEATURES)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = _waves((_matrix(b.column("x")) - mean) / scale, waves, phase)
            a += z.T @ np.hstack([z, b.column("y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(a)), pa.int32()), pa.array(list(map(list, a)), pa.list_(pa.float64()))], names=["i", "a"])

    fit, hold = F.pmod("u", F.lit(5)) != 0, F.pmod("u", F.lit(5)) == 0
    cells = data.filter(fit).mapInArrow(sums, "i int, a array<double>").select("i", F.posexplode("a").alias("j", "a")).groupBy("i", "j").agg(F.sum("a").alias("a"))
    full = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in cells.collect():  # (FEATURES + 1) * (FEATURES + 2) numbers
        full[r["i"], r["j"]] = r["a"]
    ridge = RIDGE * max(1.0, full[-1, -2]) * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    weight = np.linalg.solve(full[:, :-1] + ridge, full[:, -1])
    raw = Model(mean, scale, waves, phase, weight, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip(np.floor((raw.raw(_matrix(b.column("x"))) + 0.5) * BINS / 2), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("y")], names=["bin", "y"])

    counts = data.filter(hold if data.filter(hold).take(1) else fit).mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("g")).orderBy("bin").collect()
    if not counts:
        counts = [{"bin": BINS // 2, "n": s[0], "g": 0.5 * s[0]}]
    level = isotonic(np.array([r["n"] for r in counts]), np.array([r["g"] for r in counts]))
    return Model(mean, scale, waves, phase, weight, (np.array([r["bin"] for r in counts]) + 0.5) * 2 / BINS - 0.5, level)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score from 0 to 1, predicted (1 from THRESHOLD on).

    Null text counts as empty; an empty text has statistics 0 and a score like any other. Without a model
    every score is 0.5. Repeated rows are scored one by one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(1).to_pylist())
            y = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y), pa.array((y >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches THRESHOLD; no shuffle. Without a model all stay.
    Null texts count as empty; repeated rows are judged alike, as only the text counts."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_stack(b.column(at).to_pylist())) >= THRESHOLD)) if model and b.num_rows else b

    return docs.mapInArrow(run, docs.schema)


def held_out(col: str = "doc_id"):
    return F.coalesce(id_crc(col) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of op4 and of the pipeline: learned from labels outside the held-out fifth."""
    return learn(docs.select("doc_id", "text"), labels.filter(~held_out()))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
