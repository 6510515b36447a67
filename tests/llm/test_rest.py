import base64
import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelstream.llm import decontamination, exact_dedup, near_copies, quality, secrets, simhash, toxicity

from conftest import CLASHES


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        text = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(text.encode()).hexdigest()].append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        best = min(groups[r["text_sha256"]])
        assert r["group_size"] == len(groups[r["text_sha256"]]) and r["keep_id"] == (None if best[1] else best[2])
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_stages_keep_own_columns(spark, docs, rows):
    """Columns whose names the operators use inside come back as they were."""
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)], "doc_id long, quality int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    stages = [exact_dedup.drop_exact_copies, simhash.drop_near_copies, near_copies.drop_near_copies, lambda d: decontamination.drop_contaminated(d, items), lambda d: quality.drop_low_quality(d, labels)]
    for stage in stages:
        kept = stage(docs)
        assert kept.dtypes == docs.dtypes
        assert all(r[c] == 7 for r in kept.collect() for c in CLASHES.split())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_exact_dedup_of_repeated_ids(spark, monkeypatch, order):
    rows = [(1, "ab"), (1, "a  b "), (1, "a b"), (None, "x y"), (-(2**63), "x y"), (None, "x y"), (3, "q"), (3, "q")]
    some = [rows[k] for k in order] + rows[3:]
    df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    for heavy in (exact_dedup.HEAVY, 1):
        monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
        assert sorted((tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()), key=str) == sorted([(1, "a  b "), (-(2**63), "x y"), (3, "q")], key=str)


def test_exact_dedup_without_heavy_hitters(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "HEAVY", 1)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "three little words"), (3, None), (10, "Three, LITTLE words!"), (None, "a"), (4, "größe niño")]


def brute_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        own = fold(t)
        if item is None or not own:
            continue
        size = min(10, len(own))
        for w in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == w:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    joined = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slots", [decontamination.SLOTS, 64])
def test_decontamination(spark, docs, rows, empty, monkeypatch, slots):
    """Also with word filters that let nearly everything pass."""
    monkeypatch.setattr(decontamination, "SLOTS", slots)
    more = [(70, "so Quick brown fox jumps over the lazy dog again and again, it ran"), (71, "x three little words y three LITTLE-words"), (72, "quick brown fox jumps over the lazy dog"), (None, "three little words"), (71, "three little words")] * 2
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontamination.decontaminate(every, items).collect()), key=str)
    assert got == sorted(((i, *brute_hits(t, ITEMS)) for i, t in [*rows, *more]), key=str)
    clean = decontamination.drop_contaminated(every, items)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in got if not r[5])
    assert decontamination.decontaminate(empty, items).count() == 0
    none = decontamination.decontaminate(every, items.where("item_id = 99"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows) + len(more)


def der(*fields):
    body = b"".join(fields)
    return b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)])) + body


def test_structural_confirmation():
    key = der(b"\x02\x01\x00", b"\x02\x40" + bytes(range(64)))
    coded = base64.b64encode(key).decode()
    assert secrets.is_der_key(key) and not secrets.is_der_key(key[:-1]) and not secrets.is_der_key(b"\x30\x20" + b"\x41" * 32)
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    blob = b"\x00\x00\x00\x07ssh-rsa\x00\x00\x00\x03\x01\x00\x01\x00\x00\x00\x20" + bytes(range(32))
    text = f"é {coded} then {token}, {base64.b64encode(blob).decode()} and {key.hex()}"
    found = {(kind, text[a:b]) for a, b, kind in secrets.confirmed_spans(text)}
    assert found == {("der", coded), ("jwt", token), ("ssh", base64.b64encode(blob).decode()), ("der", key.hex())}
    for brace in ("{ ", "{\n ", "{\r\n", "{\t"):
        spaced = base64.urlsafe_b64encode(f"{brace}\"alg\": \"HS256\"}}".encode()).decode().rstrip("=") + f".{part({'sub': 1})}.c2ln"
        assert [text[a:b] for text in [f"they knew.{spaced[:3]} {spaced}."] for a, b, _ in secrets.confirmed_spans(text)] == [spaced + "."[:0]]
    fake = f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.xx " + base64.b64encode(b"\x30\x50" + b"q" * 60).decode() + " " + "30" * 40
    assert secrets.confirmed_spans(fake) == []


def test_secret_scan(docs, rows, empty):
    kinds = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]

    def brute(text):
        found = []
        for k, (kind, pattern) in enumerate(kinds):
            for m in re.finditer(pattern, text):
                length = len(m[2]) if kind == "assign" else len(m[0])
                if length >= (12, 18, 16)[k]:
                    found.append((m.start(), k, m.end(), kind))
        found.sort()
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        return *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined

    got = sorted((tuple(r)[:6] for r in secrets.scan(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t or "")) for i, t in rows), key=str)
    assert brute(dict(rows)[52])[:3] == (1, 1, 1) and secrets.scan(empty).count() == 0
    tricky = "token: secret: abcdefghijklmnop PASSWORD='1234567890ab' AKIAAKIA12345 deadbeefDEADBEEFdeadbeef"
    assert secrets._joined(secrets._in_order(secrets.base_spans(tricky))) == brute(tricky)[4]


SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert ((held.predicted == held.quality).mean() > 0.95) and found.score.between(0, 1).all()
    assert (held.predicted[held.quality == 1].mean()) > 0.97


def test_quality_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)] + [(10, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = quality.quality(docs, labels.where("quality = 9"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.drop_low_quality(docs, labels.withColumn("quality", F.lit(1))).columns == docs.columns
    assert quality.quality(empty, labels).count() == 0
    assert quality.pool_adjacent_violators([1.0, 0.0, 2.0, 1.0], [1, 1, 1, 3]).tolist() == [0.5, 0.5, 1.25, 1.25]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    held = found.join(labels, "doc_id").toPandas()
    assert len(held) == labels.count() and held.score.between(0, 1).all()
    held = held[held.held_out]
    assert held.predicted[held.toxic == 0].mean() < 0.01 and held.predicted[held.toxic == 1].mean() > 0.85


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0) for k, (i, _) in enumerate(rows)] + [(10, None, None), (None, 1, True)], "doc_id long, quality int, toxic boolean")
    labels = labels.withColumn("toxic", F.col("toxic").cast("int"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("quality = 9")).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_labels_of_one_category_only(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    held = toxicity.toxicity(docs, some).where("held_out").join(labels, "doc_id").toPandas()
    assert held.predicted[held.toxic == 0].mean() < 0.02 and held.predicted[held.toxic == 1].mean() > 0.85
    only = toxicity.learning_rows(docs, some).collect()
    assert any(np.isnan(r["y"][0]) and not np.isnan(r["y"][1]) for r in only)


def test_chain_feeds_earlier_probabilities():
    flat = toxicity.Link(np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    later = toxicity.Link(np.array([0.0, 0.0, 1.0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    p = toxicity.apply_chain([flat, later], np.array([[0.3, 0.2], [0.3, 0.9]]))
    assert p.shape == (2, 2) and np.allclose(p[:, 1], p[:, 0], atol=0.01) and (p[1] > p[0]).all()
