import random

import corpus_pipeline
import numpy as np
from voxelstream.llm import near_copies

from test_near import roots


def brute_kept(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i for (i, _), r in zip(rows, root, strict=True) if i is None or i == least[r]), key=str)


def test_stage_against_brute_force_jaccard(spark, docs, rows, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = " ".join(word() for _ in range(12))
    more = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([4, 6, 30, 150]))] + (line.split() if k % 3 == 0 else [])
        more.append((1000 + 20 * k, " ".join(base)))
        for c in range(1, rng.choice([1, 2, 4, 12])):
            changed = [w if rng.random() > 0.01 * c else word() for w in base]
            more.append((1000 + 20 * k + c, " ".join(changed)))
    every = [*rows, *more]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = sorted((r["doc_id"] for r in stage(spark, df, "").collect()), key=str)
    assert got == brute_kept(every) and len(got) < len(every) - 60
    assert stage(spark, docs, "").columns == docs.columns and stage(spark, empty, "").count() == 0


def test_near_copies_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()), key=str)
    assert got == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_similar_sets_meet_by_prefix():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 5, 256).astype(np.uint8)
    for _ in range(500):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 120), dtype=np.uint64))
        b = np.unique(np.append(rng.permutation(a)[: rng.integers(len(a) * 4 // 5, len(a) + 1)], rng.integers(0, 400, rng.integers(1, 5), dtype=np.uint64)))
        if near_copies.similar(a, b):
            assert len(np.intersect1d(near_copies.prefix(a, levels), near_copies.prefix(b, levels)))


def test_pairs_of_far_sets_are_told_by_their_parities():
    """Sets of one shared token that differ widely were all paired: the square of their number."""
    import numpy as np
    import pyarrow as pa
    from voxelstream.llm import near_copies

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:60], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])) for _ in range(60)]
    close = [np.unique(np.concatenate([s[:94], rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2)])) for s in sets]
    rows = [*sets, *close]
    assert all(map(near_copies.similar, sets, close)) and not near_copies.similar(sets[0], sets[1])
    odd = np.array([near_copies.parities(s) for s in rows]).T
    number = np.arange(len(rows))
    columns = [np.zeros(len(rows), np.int64), number, np.full(len(rows), 100, np.int32), np.zeros(len(rows), np.int32), number, *odd]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n", "at", "root", *near_copies.PARITIES])
    pairs = {(a, b) for out in near_copies._pair_rows(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert {(k, k + 60) for k in range(60)} <= pairs and len(pairs) < 300  # of 7,140
    for a, b in ((a, b) for a in range(120) for b in range(a + 1, 120)):
        assert not near_copies.similar(rows[a], rows[b]) or (a, b) in pairs
