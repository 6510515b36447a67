"""Plain Lloyd clustering of embeddings in exact integer arithmetic.

Each component x becomes floor(SCALE * x). The first centroids are the vectors whose ids hash lowest; every round
assigns each vector to its nearest centroid (squared Euclidean distance, lowest number on ties) and replaces a
centroid by the floors of its vectors' means. Centroids (k * dims integers, whatever the size of the table) are
broadcast; partitions send one row of integer sums for each of their centroids, which a group-by merges. The vectors
themselves are never shuffled or stored: each round reads them where they are.

Defined results: a vector that is null, has another number of components than ``dims``, or holds a null or non-finite
one is left out. Repeated rows each count and each get their row; of rows that tie in hash the smaller vector comes
first. A null id is clustered, but starts no centroid unless ids run out. Fewer vectors than k give fewer centroids; an
empty centroid stays where it is; an empty table gives an empty result. A component of LARGEST or more in size after
scaling is an error, as squared distances would not fit a long. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 2**27
ROWS = 4096  # vectors whose distances are held at a time


def kept_vectors(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the integers of whole and finite vectors."""
    raw = F.col(column)
    finite = F.forall(raw, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    whole = vectors.where(raw.isNotNull() & (F.size(raw) == dims)).where(finite)
    scaled = F.transform(raw, lambda x: F.floor(x.cast("double") * SCALE))
    bound = F.array_max(F.transform(raw, lambda x: F.abs(x.cast("double")))) * SCALE < LARGEST
    checked = F.when(bound, scaled).otherwise(F.raise_error(F.lit(f"a vector has a component of {LARGEST // SCALE} or more in size")).cast("array<bigint>"))
    return whole.select("vec_id", checked.alias("v"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order: at most k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    some = kept.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r["v"] for r in some], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row."""
    distance = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = x - centroid
        distance[:, c] = np.einsum("ij,ij->i", difference, difference)
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(x)), cluster]


def _blocks(frames: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            yield part, np.concatenate(part["v"].to_list()).reshape(len(part), dims).astype(np.int64, copy=False)


def sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (vectors, sum of distances, sums of components), for clusters that have vectors."""
    shared, (k, dims) = kept.sparkSession.sparkContext.broadcast(centroids), centroids.shape
    names = [f"s{d}" for d in range(dims)]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _blocks(frames, dims):
            cluster, distance = nearest(x, shared.value)
            n += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
        there = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": there.astype(np.int32), "n": n[there], "inertia": inertia[there], **{name: total[there, d] for d, name in enumerate(names)}})

    schema = ", ".join(["cluster int", *(f"{c} long" for c in ("n", "inertia", *names))])
    merged = kept.select("v").mapInPandas(partial, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "inertia", *names)])
    found = {r["cluster"]: (r["n"], r["inertia"], [r[c] for c in names]) for r in merged.collect()}
    shared.unpersist()
    return found


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept vector."""
    kept = kept_vectors(vectors, dims, column)
    centroids = first_centroids(kept, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, _, total) in sums(kept, centroids).items():
            centroids[c] = [s // n for s in total]
    inertia = {c: at for c, (_, at, _) in (sums(kept, centroids) if len(centroids) else {}).items()}
    of_cluster = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids], object)
    shared = kept.sparkSession.sparkContext.broadcast((centroids, of_cluster, digests))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, own_inertia, own_digests = shared.value
        for part, x in _blocks(frames, dims):
            cluster, distance = nearest(x, own)
            columns = {"cluster": cluster.astype(np.int32), "distance": distance, "cluster_inertia": own_inertia[cluster], "inertia": own_inertia.sum(), "centroid_sha256": own_digests[cluster]}
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64").array, **columns})

    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInPandas(assign, schema)
