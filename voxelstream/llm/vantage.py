"""Hamming links of 64-bit fingerprints through vantage-point trees.

The upper tree is fitted on a bounded sample and sent to all tasks; it deals fingerprints into shards by their
distance to the vantage points. A pair within the radius can lie on two sides of a boundary, so a fingerprint
within the radius of one is also sent along as a query; by the triangle inequality no other side can hold a
partner. Each shard goes on splitting in the same way down to small leaves, whose pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 16_384  # distinct fingerprints that the upper tree is fitted on, at most
DEPTH = 11  # levels of an upper tree, at most, so that its leaves still hold some of the sample
SHARD = 4_096  # fingerprints that a shard should hold
LEAF = 48  # fingerprints of a leaf inside a shard
BLOCK = 1 << 20  # comparisons made at a time
EDGE_BLOCK = 1 << 20  # links held before they are reduced to a forest


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray) -> tuple[np.uint64, int]:
    """A vantage point out of two or more distinct points and a radius that leaves points on both sides.

    Of a few candidates the one is taken whose distances spread most.
    """
    tried = points[np.linspace(0, len(points) - 1, min(5, len(points))).astype(int)]
    spreads = [hamming(points, v).astype(np.float64).std() for v in tried]
    vantage = tried[int(np.argmax(spreads))]
    distances = hamming(points, vantage)
    radius = int(np.median(distances))
    if radius >= distances.max():
        radius = int(distances.max()) - 1
    return vantage, radius


@dataclass
class Tree:
    """Nodes in heap order; a radius of -1 marks a leaf."""

    vantage: np.ndarray
    radius: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Tree:
        n = 2 ** (depth + 1)
        vantage, radius = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        todo = [(0, np.sort(sample), depth)]
        while todo:
            node, points, left = todo.pop()
            if not left or len(points) < 4:
                continue
            vantage[node], radius[node] = split(points)
            inside = hamming(points, vantage[node]) <= radius[node]
            todo += [(2 * node + 1, points[inside], left - 1), (2 * node + 2, points[~inside], left - 1)]
        return cls(vantage, radius)

    def deal(self, points: np.ndarray, reach: int, shard: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, point, at home) rows: each point once at home if ``home``, and as a query wherever a partner can be.

        ``shard`` is the shard so far; the new one joins it with the leaf.
        """
        node, at_home, done = np.zeros(len(points), np.int64), np.full(len(points), home), []
        while len(points):
            leaf = self.radius[node] < 0
            done.append((shard[leaf] * len(self.radius) + node[leaf], points[leaf], at_home[leaf]))
            node, points, at_home, shard = node[~leaf], points[~leaf], at_home[~leaf], shard[~leaf]
            d, r = hamming(points, self.vantage[node]).astype(np.int64), self.radius[node]
            inside = d <= r
            # At home on its own side; a pair across the boundary is found by its inner point going out as a query.
            goes_in = np.where(at_home, inside, d - reach <= r)
            goes_out = np.where(at_home, ~inside | (d + reach > r), d + reach > r)
            node, points, at_home, shard = (
                np.concatenate([2 * node[goes_in] + 1, 2 * node[goes_out] + 2]),
                np.concatenate([points[goes_in], points[goes_out]]),
                np.concatenate([at_home[goes_in], (at_home & ~inside)[goes_out]]),
                np.concatenate([shard[goes_in], shard[goes_out]]),
            )
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (shard, points, at_home)


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of the component of each of ``n`` numbers that are linked by (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that already make the same components: each component takes its first link out of it, again and again."""
    if not len(a):
        return a, b
    n, taken = int(max(a.max(), b.max())) + 1, np.zeros(len(a), bool)
    label, numbers = np.arange(n), np.arange(len(a))
    while True:
        apart = numbers[label[a] != label[b]]
        if not len(apart):
            return a[taken], b[taken]
        first = np.full(n, len(a))
        np.minimum.at(first, label[a[apart]], apart)
        np.minimum.at(first, label[b[apart]], apart)
        taken[first[first < len(a)]] = True
        label = labels(a[taken], b[taken], n)


def shard_links(home: np.ndarray, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``home`` and from ``queries`` to it: as many as connect what lies within reach, each within reach itself."""
    points = np.concatenate([home, queries])
    numbers = np.arange(len(points))
    out_a, out_b, held = [], [], 0
    todo = [(numbers[: len(home)], numbers[len(home) :])]
    while todo:
        own, asked = todo.pop()
        if not len(own) or len(own) + len(asked) < 2:
            continue
        if len(own) > LEAF:
            vantage, radius = split(points[own])
            d, q = hamming(points[own], vantage).astype(np.int64), hamming(points[asked], vantage).astype(np.int64)
            inside = d <= radius
            near = own[inside & (d + reach > radius)]
            todo.append((own[inside], asked[q - reach <= radius]))
            todo.append((own[~inside], np.concatenate([asked[q + reach > radius], near])))
            continue
        every, step = np.concatenate([own, asked]), max(1, BLOCK // len(own))
        for at in range(0, len(every), step):
            others = every[at : at + step]
            i, j = np.nonzero(hamming(points[own][:, None], points[others][None, :]) <= reach)
            real = own[i] != others[j]
            out_a.append(own[i][real])
            out_b.append(others[j][real])
            held += int(real.sum())
            if held > EDGE_BLOCK:
                a, b = spanning(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, held = [a], [b], len(a)
    if not out_a:
        return points[:0], points[:0]
    a, b = spanning(np.concatenate(out_a), np.concatenate(out_b))
    return points[a], points[b]


def _deal(points: np.ndarray, trees: list[Tree], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, point, at home) by the sides that a point takes in all trees."""
    shard, home = np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for tree in trees:
        own, asked = (tree.deal(points[x], reach, shard[x], h) for x, h in ((home, True), (~home, False)))
        shard, points, home = (np.concatenate(x) for x in zip(own, asked, strict=True))
    return shard, points, home


def hamming_links(fingerprints: DataFrame, reach: int) -> DataFrame:
    """Distinct ``fp`` longs -> (a, b) links within ``reach`` bits that connect whatever lies within them.

    A tree over a bounded sample has at most DEPTH levels. More fingerprints take more trees, each over a sample of
    its own, and a shard is a leaf of every tree: shards keep their size however many fingerprints there are.
    """
    sc = fingerprints.sparkSession.sparkContext
    n, trees = fingerprints.count(), []
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    while depth > 0:
        rows = fingerprints.orderBy(F.xxhash64("fp", F.lit(len(trees))), "fp").limit(SAMPLE).collect()
        trees.append(Tree.fit(np.array([r[0] for r in rows], np.int64).view(np.uint64), min(depth, DEPTH)))
        depth -= DEPTH
    shared = sc.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                points = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                shard, fp, home = _deal(points, shared.value, reach)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp.view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp, home = group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        a, b = shard_links(fp[home], fp[~home], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fingerprints.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long")
