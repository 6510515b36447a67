import numpy as np
import xxhash
from voxelstream.llm import simhash, vantage
from voxelstream.llm.components import connected_components


def brute_print(text: bytes) -> int:
    words = text.lower().split()
    shingles = [b" ".join(words)] * bool(words) if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_and_components(docs, rows):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.simhash(docs).collect()), key=str)
    prints = [brute_print((t or "").encode()) for _, t in rows]
    near = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {}
    for (i, _), r in zip(rows, near, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i is None, i or 0, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, near, strict=True)), key=str)
    assert got == want


def test_stage_keeps_one_of_each(docs, empty):
    found = {(r["doc_id"], r["component_id"]) for r in simhash.simhash(docs).collect()}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in found if i is None or i == c}
    assert simhash.simhash(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_trees_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(10):
        points = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
        for _ in range(300):
            x = points[rng.integers(len(points))]
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            points.append(x)
        points = np.unique(np.array(points, np.uint64))
        place = {int(v): i for i, v in enumerate(points)}
        trees = [vantage.Tree.fit(points[::3], 4), vantage.Tree.fit(points[1::3], 2)]
        shard, fp, home = vantage._deal(points, trees, 2)
        assert home.sum() == len(points)
        links = []
        for s in np.unique(shard):
            links += zip(*vantage.shard_links(fp[(shard == s) & home], fp[(shard == s) & ~home], 2), strict=True)
        i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
        assert roots(len(points), [(place[int(a)], place[int(b)]) for a, b in links]) == roots(len(points), zip(i, j, strict=True))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 120)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 120)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
