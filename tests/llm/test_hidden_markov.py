"""The hidden Markov language model against plain recursions, its base against counts, and its score on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelstream.llm import hidden_markov as hm

SF = "/root/testdata/sf0.001"


def fold(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ")


def brute_base(rows):
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*[w for w in fold(t) if w], None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if held(i) is False for w in ws)
    total, distinct = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
    return [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, base(ws)) for i, ws in tokens], count


def brute_forward(model, symbols):
    """log10 likelihood in plain Python."""
    a, out = [float(x) for x in model.start], 0.0
    for k, s in enumerate(symbols):
        if k:
            a = [sum(a[i] * model.move[i][j] for i in range(len(a))) for j in range(len(a))]
        a = [x * model.emit[s][j] for j, x in enumerate(a)]
        c = sum(a)
        a, out = [x / c for x in a], out + math.log10(c)
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in {"OWN": 5, "CLASSES": 7, "RANKED": 9, "TOKENS": 300, "STRETCH": 50, "WORD_BYTES": 6}.items():
        monkeypatch.setattr(hm, name, value)


def check(df, rows, **settings):
    got = hm.score_texts(df, **settings)
    assert got.columns == "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    got, (want, count) = got.collect(), brute_base(rows)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and g["base_score"] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and math.isfinite(g["score"])
    return got, count


def test_base(docs, rows):
    check(docs, rows, states=3, rounds=1)


def test_scores_are_probabilities_of_whole_texts(spark, docs, rows, small):
    """Every text's score by the trained tables, its words' shares from plain counts and a plain forward recursion."""
    got, count = check(docs, rows, states=3, rounds=2)
    words = hm.vocabulary(docs)
    ends = sum(i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    corpus = hm.corpus_of(words, ends)
    model = hm.fit(hm.as_symbols(docs, corpus), corpus, 3, 2)
    assert model.emit.sum(axis=0) == pytest.approx(np.ones(3)) and model.move.sum(axis=1) == pytest.approx(np.ones(3))
    short = sorted((w for w in count if w and len(w) <= hm.WORD_BYTES), key=lambda w: (-count[w], w))
    own = {w: 1 + k for k, w in enumerate(short[: hm.OWN])} | {None: 0}
    classes = {}
    for w in count:
        if w not in own:
            classes.setdefault(hm.class_of(w, hm.CLASSES), []).append(count[w])
    want = []
    for i, text in rows:
        ws = [*[w for w in fold(text) if w], None]
        total = brute_forward(model, [own[w] if w in own else 1 + hm.OWN + hm.class_of(w, hm.CLASSES) for w in ws])
        for w in ws:
            if w not in own:
                c = classes.get(hm.class_of(w, hm.CLASSES), [])
                total += math.log10((count[w] + 0.1) / (sum(c) + 0.1 * (len(c) + 1)))
        want.append((str(i), round(total, 6)))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted(want)


def test_expected_counts():
    """Side by side as one by one, by sums over state pairs."""
    rng = np.random.default_rng(1)
    states, symbols = 3, 6
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))
    sequences = [rng.integers(0, symbols, n) for n in (4, 1, 9, 4, 2)]
    emissions = np.zeros((symbols, states))
    some = hm.SideBySide(sequences)
    starts, moves, total = some.expected(model, emissions)
    want = [np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))]
    for s in sequences:
        alpha = [model.start * model.emit[s[0]]]
        for x in s[1:]:
            alpha.append(alpha[-1] @ model.move * model.emit[x])
        beta = [np.ones(states)]
        for x in s[:0:-1]:
            beta.insert(0, model.move @ (model.emit[x] * beta[0]))
        p = alpha[-1].sum()
        want[0] += alpha[0] * beta[0] / p
        for k, x in enumerate(s):
            want[2][x] += alpha[k] * beta[k] / p
            if k:
                want[1] += np.outer(alpha[k - 1], model.emit[x] * beta[k]) * model.move / p
    assert starts == pytest.approx(want[0]) and moves == pytest.approx(want[1]) and emissions == pytest.approx(want[2])
    lone = [brute_forward(model, s) for s in sequences]
    assert total == pytest.approx(sum(lone)) and some.likelihoods(model) == pytest.approx(np.array(lone))


def test_rounds_raise_the_likelihood(spark):
    """On training rows each round does better; on rows never learned from the trained model beats the base."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    scores = [hm.score_texts(df, states=4, rounds=n).groupBy("held_out").agg(F.sum("score"), F.sum("base_score")).collect() for n in (0, 2, 5)]
    train = [next(r[1] for r in s if r[0] is False) for s in scores]
    assert train[0] < train[1] < train[2]
    assert all(r[1] > r[2] for r in scores[-1])


def test_odd_tables(spark, empty):
    assert hm.score_texts(empty).count() == 0
    untrained = [(None, "a B"), (None, None), (None, "A b")]
    check(spark.createDataFrame(untrained, "doc_id long, text string"), untrained)
    texts = [(i, t) for i in range(12) for t in (None, "", " \x0b\x0c\r", "É é E", "x\x1cy\x85z\xa0w", "w" * 5000, "Straße " * 3)]
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), texts, states=2, rounds=1)
