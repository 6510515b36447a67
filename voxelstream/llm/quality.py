"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a whole text (shares of character classes, word and line shapes, repetition) are standardised and
mapped to cosines with random Gaussian frequencies, whose inner products approximate a Gaussian kernel. Normal
equations are summed per partition and fold, then over partitions, so the driver only sees matrices of fixed
size. Each of two folds is scored by the model of the other; the pool of those scores, counted in BINS bins, is
calibrated by pooling adjacent violators. The final model uses both folds.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; no id, language, source or label
is an input of a score.

Defined results: null text counts as empty, and empty texts get a score like any other; a null doc_id is scored
but never learned from, with a null held_out; labels that are null are ignored and contradicting ones averaged;
repeated rows each get their row; with no labels of both kinds every score is the share of good labels (0.5
without any); an empty table gives an empty result; further columns are carried by the stage and ignored by the
report.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import materialize, own, slices, utf8

FEATURES = 192  # cosines
WIDTH = 1.5  # of the Gaussian kernel, in standard deviations times the root of the number of statistics
RIDGE = 2.0
BINS = 512
SEED = 20
LEARN_ROWS = None  # all labelled rows are learned from
PUNCTUATION = b"!$%&*#|.,;:?-_/<>()[]{}@\"'="


def statistics(text: bytes) -> np.ndarray:
    """Fixed number of statistics of a whole text; zeros and ones for an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(n, 1)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words, lines = text.split(), text.split(b"\n")
    k = len(words)
    repeats = Counter(lines)
    lengths = np.fromiter(map(len, words), np.int64, k) if k else np.zeros(1, np.int64)
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    line_bytes = sum(len(x) * c for x, c in repeats.items() if c > 1 and x)
    tails = Counter(w[-1:] for w in words)
    return np.array(
        [
            np.log1p(n), np.log1p(k), np.log1p(len(lines)), upper, lower, digits, counts[128:].sum(), counts[32], counts[10],
            *(counts[c] for c in PUNCTUATION), counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum(),
            counts[:9].sum() + counts[14:32].sum(), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(kinds) / max(k, 1), max(kinds.values(), default=0) / max(k, 1), pairs / max(k - 1, 1),
            len(repeats) / len(lines), line_bytes / max(n, 1), sum(tails[c] for c in (b".", b"!", b"?")) / max(k, 1),
            sum(w[:1].isupper() for w in words) / max(k, 1), sum(w.isupper() for w in words) / max(k, 1), k / len(lines),
        ]
    )


N_STATISTICS = len(statistics(b""))


def _statistics_column(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``__stats`` for each document."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], utf8().alias("__text"))
    out = rows.drop("__text").schema.add("__stats", ArrayType(DoubleType()))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "__stats"])

    return rows.mapInArrow(compute, out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores there

    @staticmethod
    def basis() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.normal(0, 1 / (WIDTH * np.sqrt(N_STATISTICS)), (N_STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    @staticmethod
    def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Cosines, the standardised statistics themselves and a constant."""
        x = np.clip((stats - mean) / scale, -6, 6)
        w, phase = Model.basis()
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + phase), x / np.sqrt(N_STATISTICS), np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats, self.mean, self.scale) @ self.weights
        calibrated = np.interp(raw, self.edges, self.levels)
        # A little of the raw score keeps the order inside level stretches; the sides of 0.5 stay as they are.
        order = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
        mixed = calibrated + 0.002 * (order - 0.5)
        mixed = np.where(calibrated >= 0.5, np.maximum(mixed, 0.5), np.minimum(mixed, np.nextafter(0.5, 0)))
        return np.clip(mixed, 0, 1)


def pool_adjacent_violators(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _solve(matrix: np.ndarray) -> np.ndarray:
    """Weights from summed [z, y]' [z, y]; the constant is not shrunk."""
    a, b = matrix[:-1, :-1], matrix[:-1, -1]
    shrink = np.full(len(a), RIDGE)
    shrink[-1] = 1e-6
    return np.linalg.solve(a + np.diag(shrink), b)


def labelled(docs: DataFrame, labels: DataFrame, name: str = "quality") -> DataFrame:
    """(y, fold, stats) of the rows to learn from, written once; folds 0 and 2 of crc32 mod 3."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    truth = labels.where(f"{name} is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.avg(name).alias("__y"))
    rows = _statistics_column(docs.where(fold != 1).select("doc_id", fold.cast("int").alias("fold"), "text"), ["doc_id", "fold"])
    rows = rows.withColumn("__stats", F.col("__stats").cast("array<float>")).join(truth, F.col("doc_id") == F.col("__id"))
    return materialize(rows.select((F.col("__y") >= 0.5).cast("double").alias("y"), "fold", "__stats"), "labelled-statistics")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each statistic."""
    long = rows.select(F.posexplode("__stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    mean, scale = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
    for r in long.collect():  # one row per statistic
        mean[r["i"]], scale[r["i"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    return mean, scale


def _normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """fold -> sum of [z, y]' [z, y], summed inside partitions first; one row per line of the matrix."""
    width = FEATURES + N_STATISTICS + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, 512):
            y, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            z = np.hstack([Model.features(np.array(batch.column(2).to_pylist()), mean, scale), y[:, None]])
            for k in np.unique(fold):
                part = z[fold == k]
                sums[int(k)] = sums.get(int(k), 0) + part.T @ part
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, k, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["fold", "line", "sums"]
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in group["sums"]], axis=0)
        return pd.DataFrame({"fold": group["fold"].iloc[:1], "line": group["line"].iloc[:1], "sums": [total.tobytes()]})

    schema = "fold int, line int, sums binary"
    found: dict[int, np.ndarray] = {}
    for fold, line, sums in rows.select("y", "fold", "__stats").mapInArrow(partial, schema).groupBy("fold", "line").applyInPandas(add, schema).collect():
        found.setdefault(fold, np.zeros((width, width)))[line] = np.frombuffer(sums)
    return found


def fit(docs: DataFrame, labels: DataFrame, name: str = "quality") -> Model:
    rows = labelled(docs, labels, name)
    mean, scale = _moments(rows)
    sums = _normal_equations(rows, mean, scale)
    n, good = (sum(m[-2, -2] for m in sums.values()), sum(m[-1, -1] for m in sums.values())) if sums else (0, 0)
    width = FEATURES + N_STATISTICS + 1
    if not 0 < good < n or len(sums) < 2:
        share = good / n if n else 0.5
        return Model(mean, scale, np.zeros(width), np.array([0.0]), np.array([share]))
    folds = sorted(sums)
    crossed = {k: _solve(sums[folds[1 - i]]) for i, k in enumerate(folds)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            z, fold = Model.features(np.array(batch.column(2).to_pylist()), mean, scale), batch.column(1).to_numpy()
            raw = np.where(fold == folds[0], z @ crossed[folds[0]], z @ crossed[folds[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)), pa.array(raw)], names=["y", "bin", "raw"])

    pooled = rows.select("y", "fold", "__stats").mapInArrow(score, "y double, bin long, raw double").groupBy("bin").agg(F.count("*"), F.sum("y"), F.avg("raw")).orderBy("bin").collect()
    counts, goods, raws = (np.array([float(r[k]) for r in pooled]) for k in (1, 2, 3))
    prior = good / n
    levels = pool_adjacent_violators((goods + prior) / (counts + 1), counts)
    return Model(mean, scale, _solve(sum(sums.values())), raws, levels)


def apply_model(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document and ``__score``: texts go to one Python worker a task, once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], utf8().alias("__text"))
    out = rows.drop("__text").schema.add("__score", DoubleType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.score(np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "__score"])

    return rows.mapInArrow(score, out)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = apply_model(docs, fit(docs, labels), ["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with their own columns."""
    return apply_model(docs.select(own(docs), "text"), fit(docs, labels), ["own"]).where("__score >= 0.5").select("own.*")
