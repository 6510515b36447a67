import hashlib
import random

import numpy as np
import pytest
from voxelstream.llm import suffix_array as sa
from voxelstream.llm import suffix_dedup as sd


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(sa, "DIRECT", 8)
    monkeypatch.setattr(sa, "BUCKETS", 16)


def test_suffix_array_and_prefixes(small_steps):
    rng = np.random.default_rng(0)
    for t in range(120):
        s = rng.integers(1, rng.integers(2, 40), rng.integers(2, 300))
        s = np.append(np.tile(s[: max(1, len(s) // 7)], 8) if t % 3 == 0 else s, 0)
        got, text = sa.suffix_array(s, int(s.max()) + 1), s.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert got.tolist() == want
        plcp = sa.permuted_lcp(s.astype(np.int32), got, 0)
        for a, b in zip(want, want[1:], strict=False):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k] > 0:
                k += 1
            assert plcp[b] == k


def test_repeated_windows(small_steps):
    rng = random.Random(1)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(5, 30))) for _ in range(rng.randint(1, 20))]
        owner, place = (np.array([rng.randint(0, 9) for _ in parts]) for _ in range(2))
        first: dict = {}
        every = [(i, o, s[o : o + 5], (owner[i], place[i] + o)) for i, s in enumerate(parts) for o in range(len(s) - 4)]
        for _, _, w, key in every:
            first[w] = min(first.get(w, key), key)
        got = sa.repeated_windows(parts, owner, place, 5)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == {(i, o) for i, o, w, key in every if key != first[w]}


def test_segments_of_pieces():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 100, 3000).astype(np.uint8))
    whole = sd.segments(data, np.array([3000]))
    assert whole[1].sum() == 3000 - sd.SIZE + 1
    cut = sd.segments(data, np.array([1000, 50, 1950]))
    assert cut[1].sum() == (1000 - sd.SIZE + 1) + (1950 - sd.SIZE + 1)


def brute(rows):
    seen, out = set(), []
    keyed = sorted({(sd.LAST if i is None else i, (t or "").encode()) for i, t in rows})
    for doc, text in keyed:
        covered = np.zeros(len(text) + 1, int)
        for j in range(len(text) - sd.SIZE + 1):
            window = text[j : j + sd.SIZE]
            if window in seen:
                covered[j] += 1
                covered[j + sd.SIZE] -= 1
            seen.add(window)
        hit = np.cumsum(covered)[: len(text)] > 0
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~hit])).hexdigest()
        out.append((None if doc == sd.LAST else doc, len(text), int(hit.sum()), runs, kept))
    return out


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_against_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    got = [tuple(r) for r in sd.suffix_dedup(docs).collect()]
    want = brute(rows)
    assert len(got) == len(rows) and set(got) == set(want)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_left_text_and_empty(docs, empty):
    left = {r["doc_id"]: r["text"] for r in sd.removed_text(docs).collect()}
    assert left[40] == left[41] == "" and left[43] == "a" and len(left[48]) == 0
    assert sd.suffix_dedup(empty).count() == 0
