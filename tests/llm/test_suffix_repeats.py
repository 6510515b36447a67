import random

import pytest
from test_suffix import brute
from voxelstream.llm import suffix_dedup as sd


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_repeated_rows_keep_a_first_copy(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(4)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=n)) for n in (400, 300, 500))
    rows = [(1, a), (1, a), (None, b), (None, b), (3, c + a[:150]), (3, c + a[:150]), (3, a[:200] + b), (4, c)]
    got = sorted((tuple(r) for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    # A result for each row; the same for rows that are one document.
    want = {(r[0], r[1]): r for r in brute(rows)}
    assert got == sorted((want[(i, len(t))] for i, t in rows), key=str)
    assert [r[2] for r in got if r[0] == 1] == [0, 0]
