"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. A model sees word features and the probabilities of the categories
before it; in training those are out-of-fold predictions, so that a later model learns from probabilities as
honest as those it meets when applied. Models are ridge regressions whose normal equations are summed per
partition and fold; scores are calibrated by isotonic regression on the out-of-fold scores.

Features are the FEATURES words and word beginnings whose presence tells most between a category's two classes.
They and the models are learned from at most about LEARN_ROWS labelled rows, chosen by a hash of their id; every
document is scored on its whole text. Rows whose crc32(doc_id as text) mod 3 is 1 are never learned from.

Defined results: null text counts as empty and gets a score like any other; a null doc_id is scored, never learned
from, with a null held_out; labels that are null are ignored and contradicting ones averaged; repeated rows each
get their row; a category with no rows of one kind has the share of the other as its score (0 without any rows);
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty
from .quality import pool_adjacent_violators

LEARN_ROWS = 20_000
FEATURES = 400  # for each category
BEGINNINGS = (4, 5, 6)  # characters of word beginnings
LEAST_ROWS = 4  # documents that must hold a feature
RIDGE = 8.0  # keeps weights small where labels are few
BINS = 512

#: Categories in the order of the chain: (name, label column, value that marks it).
CHAIN = (("junk", "quality", 0), ("toxic", "toxic", 1))

_WORDS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> Counter:
    """Words and marked word beginnings with their counts."""
    found: Counter = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        found[word] += n
        for k in BEGINNINGS:
            if len(word) > k:
                found["^" + word[:k]] += n
    return found


class Features:
    """Texts -> rows of log counts of the chosen tokens, their evidence for each category, and the length.

    ``evidence`` has the log odds of each token and category; a text gets the greatest and the sum of the positive
    ones of its tokens.
    """

    def __init__(self, chosen: list[str], evidence: np.ndarray):
        self.place = {t: i for i, t in enumerate(chosen)}
        self.evidence = np.maximum(evidence, 0).astype(np.float32)
        self.width = len(chosen) + 2 * len(CHAIN) + 2

    def of(self, text: str) -> np.ndarray:
        row, of = np.zeros(self.width, np.float32), self.place.get
        words = Counter(_WORDS.findall(text.lower()))
        for word, n in words.items():
            if (i := of(word)) is not None:
                row[i] += n
            for k in BEGINNINGS:
                if len(word) > k and (i := of("^" + word[:k])) is not None:
                    row[i] += n
        n, k = len(self.place), len(CHAIN)
        if (there := np.flatnonzero(row[:n])).size:
            row[n : n + k] = self.evidence[there].max(axis=0) / 4
            row[n + k : n + 2 * k] = np.log1p(self.evidence[there].sum(axis=0))
        row[:n] = np.log1p(row[:n])
        row[-2] = np.log1p(sum(words.values())) / 10
        row[-1] = 1.0
        return row


@dataclass
class Link:
    """One model of the chain: weights over features and earlier probabilities, and its calibration."""

    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = x @ self.weights
        order = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
        level = np.interp(raw, self.edges, self.levels)
        mixed = level + 0.002 * (order - 0.5)  # keeps the order inside level stretches, and the side of 0.5
        return np.clip(np.where(level >= 0.5, np.maximum(mixed, 0.5), np.minimum(mixed, np.nextafter(0.5, 0))), 0, 1)


def apply_chain(links: list[Link], x: np.ndarray) -> np.ndarray:
    """(rows, categories) probabilities, each fed to the models after it."""
    out = np.zeros((len(x), 0))
    for link in links:
        out = np.hstack([out, link.probability(np.hstack([x, out]))[:, None]])
    return out


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, y, text): a bounded number of labelled rows, joined by a broadcast of that bound. A label that is null is NaN."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    marks = [F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double"))).alias(f"y{k}") for k, (_, c, v) in enumerate(CHAIN)]
    truth = labels.where("doc_id is not null").where(fold != 1).groupBy("doc_id").agg(*marks).dropna("all", subset=[f"y{k}" for k in range(len(CHAIN))])
    n = truth.count()
    some = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // LEARN_ROWS)))) == 0)
    some = some.select(F.col("doc_id").alias("__id"), F.array(*[F.coalesce((F.col(f"y{k}") >= 0.5).cast("double"), F.lit(float("nan"))) for k in range(len(CHAIN))]).alias("y"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    return materialize(rows.select(fold.cast("int").alias("fold"), "y", "text"), "toxicity-rows")


def choose_features(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Tokens, and their log odds for each category, by how much their presence tells between the classes of a category (log odds times share)."""
    ns, ts = ([f"{c}{k}" for k in range(len(CHAIN))] for c in ("marked", "known"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, marked = Counter(), [Counter() for _ in CHAIN], [Counter() for _ in CHAIN]
        for batch in slices(batches):
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = tokens(text).keys()
                total.update(found)
                for k, one in enumerate(y):
                    if one == one:  # not NaN
                        known[k].update(found)
                        if one:
                            marked[k].update(found)
        for part in range(0, len(total), 65_536):
            some = list(total)[part : part + 65_536]
            columns = [pa.array(some, pa.string()), pa.array([total[t] for t in some], pa.int64()), *(pa.array([m[t] for t in some], pa.int64()) for m in [*marked, *known])]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "n", *ns, *ts])

    counts = rows.select("y", "text").mapInArrow(count, ", ".join(["token string", "n long", *(f"{c} long" for c in [*ns, *ts])]))
    counts = materialize(counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", *ns, *ts)]).where(F.col("n") >= LEAST_ROWS), "token-counts")
    label = [F.nullif(F.col("y")[k], F.lit(float("nan"))) for k in range(len(CHAIN))]
    sizes = rows.agg(*[F.sum(y) for y in label], *[F.sum(1 - y) for y in label]).first()
    chosen: dict[str, list[float]] = {}
    odds, tell = [], []
    for k, (marked, known) in enumerate(zip(ns, ts, strict=True)):
        on, off = max(sizes[k] or 0, 1), max(sizes[len(CHAIN) + k] or 0, 1)
        other = F.col(known) - F.col(marked)
        odds.append(F.log(((F.col(marked) + 0.5) / on) / ((other + 0.5) / off)))
        tell.append(F.abs(odds[k]) * F.greatest(F.col(marked) / on, other / off))
    for tells in tell:
        best = counts.select("token", F.array(*odds).alias("odds"), F.round(tells, 9).alias("tells")).orderBy(F.desc("tells"), "token").limit(FEATURES)
        chosen |= {r["token"]: r["odds"] for r in best.collect()}
    return list(chosen), np.array(list(chosen.values()), np.float64).reshape(-1, len(CHAIN))


def _summed(rows: DataFrame, k: int, crossed: list[dict[int, Link]]) -> dict[int, np.ndarray]:
    """fold -> sum of [x, earlier, y]' [x, earlier, y] for category ``k``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, 1024):
            x, y, fold = _arrays(batch, k)
            x = np.hstack([x, _out_of_fold(x, fold, crossed)])
            z = np.hstack([x, y[:, k : k + 1]])
            for f in np.unique(fold):
                part = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        for f, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["fold", "line", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in group["sums"]], axis=0)
        return pd.DataFrame({"fold": group["fold"].iloc[:1], "line": group["line"].iloc[:1], "sums": [total.tobytes()]})

    schema, found = "fold int, line int, sums binary", {}
    for fold, line, sums in rows.mapInArrow(partial, schema).groupBy("fold", "line").applyInPandas(add, schema).collect():
        row = np.frombuffer(sums)
        found.setdefault(fold, np.zeros((len(row), len(row))))[line] = row
    return found


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the rows whose label of category ``k`` is known."""
    y = np.array(batch.column("y").to_pylist()).reshape(-1, len(CHAIN))
    x = batch.column("x").flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    known = ~np.isnan(y[:, k])
    return x[known].astype(np.float64), y[known], batch.column("fold").to_numpy()[known]


def _out_of_fold(x: np.ndarray, fold: np.ndarray, crossed: list[dict[int, Link]]) -> np.ndarray:
    """Earlier probabilities of each row by the models that did not learn from its fold."""
    out = np.zeros((len(x), 0))
    for models in crossed:
        wide, p = np.hstack([x, out]), np.zeros(len(x))
        for f, model in models.items():
            p[fold == f] = model.probability(wide[fold == f])
        out = np.hstack([out, p[:, None]])
    return out


def _solve(total: np.ndarray) -> np.ndarray:
    a, b = total[:-1, :-1], total[:-1, -1]
    return np.linalg.solve(a + np.diag(np.full(len(a), RIDGE)), b)


def _calibrated(rows: DataFrame, k: int, crossed: list[dict[int, Link]], weights: dict[int, np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic levels over bins of the out-of-fold scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x, y, fold = _arrays(batch, k)
            x, raw = np.hstack([x, _out_of_fold(x, fold, crossed)]), np.zeros(len(x))
            for f, w in weights.items():
                raw[fold == f] = x[fold == f] @ w
            bins = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(y[:, k]), pa.array(raw)], names=["bin", "y", "raw"])

    pooled = rows.mapInArrow(score, "bin long, y double, raw double").groupBy("bin").agg(F.count("*"), F.sum("y"), F.avg("raw")).orderBy("bin").collect()
    n, good, raws = (np.array([float(r[i]) for r in pooled]) for i in (1, 2, 3))
    return raws, pool_adjacent_violators((good + prior) / (n + 1), n)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Features, list[Link]]:
    texts = learning_rows(docs, labels)
    features = Features(*choose_features(texts))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.array(x, pa.list_(pa.float32()))], names=["fold", "y", "x"])

    rows = materialize(texts.mapInArrow(compute, "fold int, y array<double>, x array<float>"), "toxicity-features")
    links: list[Link] = []
    crossed: list[dict[int, Link]] = []
    for k in range(len(CHAIN)):
        sums = _summed(rows, k, crossed)
        n, on = (sum(s[features.width - 1, features.width - 1] for s in sums.values()), sum(s[-1, -1] for s in sums.values())) if sums else (0, 0)
        if not 0 < on < n or len(sums) < 2:
            flat = Link(np.zeros(features.width + k), np.zeros(1), np.array([on / n if n else 0.0]))
            links.append(flat)
            crossed.append(dict.fromkeys(sums, flat))
            continue
        folds = sorted(sums)
        other = {f: _solve(sums[folds[1 - i]]) for i, f in enumerate(folds)}
        edges, levels = _calibrated(rows, k, crossed, other, on / n)
        links.append(Link(_solve(sum(sums.values())), edges, levels))
        crossed.append({f: Link(w, edges, levels) for f, w in other.items()})
    return features, links


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (of the last category), predicted, and ``<category>_score`` for those before it."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = [f"{name}_score" for name, _, _ in CHAIN[:-1]] + ["score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, links = shared.value
        for batch in slices(batches):
            x = np.array([features.of(t) for t in batch.column("text").to_pylist()], np.float64)
            p = apply_chain(links, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names)))], names=["doc_id", *names])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = typed.mapInArrow(score, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *names[:-1])
