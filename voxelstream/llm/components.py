"""Connected components of an edge table: partitions are contracted on their own, then joined by star steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vantage import labels

LINKS = 1 << 20  # links that a partition should hold
MAX_ROUNDS = 60  # each round shrinks paths; a graph that has not settled by then is an error


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition -> (node, least node of its component there)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    while held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = labels(places[: len(a)], places[len(a) :], len(nodes))
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])
        held = []


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): the root is the least node of the component; roots themselves included.

    In every round each partition, of about LINKS links, turns its links into stars. Once they fit one partition that
    is all; before, star steps join the partitions. The hub of a large star is pre-aggregated where it is grouped and
    left to AQE's skew join where it is joined.
    """
    stars = materialize(edges.where("a <> b").select("a", "b"), "links")
    state = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        parts = math.ceil(state[0] / LINKS)
        stars = stars.coalesce(parts).mapInArrow(_contracted, "a long, b long")
        if parts == 1:
            stars = materialize(stars, "stars")
            break
        stars = materialize(_small_star(_large_star(stars)), "stars")
        before, state = state, _state(stars)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
