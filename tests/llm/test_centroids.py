"""Lloyd clustering against plain Python, and the cases that its docstring states."""

import hashlib
import math

import numpy as np
import pytest
from voxelstream.llm import centroids


def brute(rows, k, rounds, dims, salt="2:"):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    mid = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(mid))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        for n in range(len(mid)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == n]
            if own:
                mid[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    of = {n: sum(d for _, d, c in last if c == n) for n in range(len(mid))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in mid]
    return [(i, n, d, of[n], sum(of.values()), sha[n]) for i, d, n in last]


def rows_of(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims)]) for i in range(n)]
    odd = [(None, rows[0][1]), (None, rows[1][1]), (7, rows[7][1]), (7, rows[7][1]), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None, *[1.0] * (dims - 1)])]
    odd += [(904, [math.nan] * dims), (905, [math.inf, *[0.0] * (dims - 1)]), (906, [0.0] * dims), (907, [-0.001] * dims)]
    return rows + odd


@pytest.mark.parametrize(("n", "k", "dims"), [(300, 6, 8), (30, 40, 4), (0, 3, 4), (200, 1, 64)])
def test_lloyd(spark, n, k, dims):
    rows = rows_of(n, dims) if n else []
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, v int, cluster int").repartition(3)
    got = centroids.lloyd(df, k=k, dims=dims)
    assert got.columns == "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    want = brute([(i, v) for i, v in rows], k, 5, dims)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_doubles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 7)
    rows = [(i, [x / 3 for x in v]) for i, v in rows_of(60, 5, 3) if v is not None and None not in v]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(str, map(tuple, centroids.lloyd(df, k=4, rounds=3, dims=5).collect()))) == sorted(map(str, brute(rows, 4, 3, 5)))


def test_ties_take_the_lower_number():
    cluster, distance = centroids.nearest(np.array([[0, 0], [3, 0]]), np.array([[2, 0], [-2, 0], [4, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [4, 1]


def test_empty_centroids_stay(spark):
    """Equal vectors give equal centroids, of which the first takes all."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in centroids.lloyd(df, k=3, dims=2).collect()} == {(0, 0, 0)}


def test_vectors_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="in size"):
        centroids.lloyd(df, k=2, dims=2).collect()
