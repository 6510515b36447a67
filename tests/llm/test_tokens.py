import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer
from voxelstream.llm import bpe, bpe_native, repair, token_counts, token_store
from voxelstream.llm.repair import Shard, pack

RANKS, JSON = public.path("byte_bpe_multi_50k.tiktoken"), public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, rows):
    out = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(docs, rows, reference, empty):
    assert sorted((tuple(r) for r in bpe.round_trip(docs, RANKS, public.PATTERN).collect()), key=str) == expected(reference, rows)
    assert bpe.round_trip(empty, RANKS, public.PATTERN).count() == 0


def test_native_round_trip(spark, rows, reference):
    few = [r for r in rows if len(r[1] or "") < 300]
    found = bpe_native.round_trip(spark.createDataFrame(few, "doc_id long, text string"), RANKS, public.PATTERN)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(reference, few)


def test_encode_then_decode(docs, rows):
    found = bpe.decode_documents(bpe.encode_documents(docs, RANKS, public.PATTERN), RANKS)
    assert sorted(bytes(r["data"]).decode() for r in found.collect()) == sorted(t or "" for _, t in rows)


def test_long_words(reference):
    own, rng = bpe.Bpe(bpe.read_ranks(RANKS), public.PATTERN), random.Random(3)
    texts = ["a" * 3000, "ab" * 2000, "日本語テキスト" * 50, "😀😃" * 60, *("".join(rng.choices("etaoinshé", k=200)) for _ in range(40))]
    texts += [" ".join("".join(rng.choices("etaoinshrdlué'ñ.,-!0中\n", k=rng.randint(1, 60))) for _ in range(400)) for _ in range(8)] + ["", " ", "a"]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [reference.encode_ordinary(t) for t in texts]


def test_counts_and_cache(spark, docs, rows, tmp_path):
    library, path = Tokenizer.from_file(JSON), str(tmp_path / "cache")
    want = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t) in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=str)
    for _ in range(2):
        got = token_counts.token_counts(docs, JSON, path, limit=100)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert spark.read.parquet(path).count() == len({t or "" for _, t in rows})


def test_second_run_encodes_nothing(docs, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    first = sorted(map(str, token_counts.token_counts(docs, JSON, path).collect()))

    def none(*_):
        raise AssertionError("something was encoded")

    monkeypatch.setattr(token_counts, "_counter", none)
    assert sorted(map(str, token_counts.token_counts(docs, JSON, path).collect())) == first


def test_counts_of_special_strings_and_other_kinds(spark, empty):
    texts = [(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|>b c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public.path(name))
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, public.path(name)).collect()}
        assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, public.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(model.encode(t)) for i, t in texts}
    assert token_counts.token_counts(empty, JSON).count() == 0


def test_store(docs, rows, empty):
    library = Tokenizer.from_file(JSON)
    ids = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]
    got = token_store.token_store(docs, JSON).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids), key=str)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered[:-1]]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    assert token_store.token_store(empty, JSON).count() == 0


def test_shards_read_at_random():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000, 60000):
        ids = (rng.zipf(1.3, n) % 500).astype(np.int64)
        documents = np.array_split(ids, max(1, n // 70))
        shard = Shard.unpack(pack([None, *range(1, len(documents))], documents, 50257))
        assert (shard.all_ids() == ids).all() and shard.doc_ids[0] is None
        for k in range(0, len(documents), 7):
            assert (shard.document(k) == documents[k]).all()
    assert len(shard.symbols) < n and (shard.lengths >= 2).all()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 50257, 3000)
    for ids in (np.tile(base, 60), (rng.zipf(1.3, 50_000) % 50257).astype(np.int64), np.zeros(5000, np.int64), np.tile([1, 2, 1, 2, 2], 900)):
        symbols, rules, lengths = repair.compress(ids, 50257)
        assert (repair.expand(symbols, rules, 50257) == ids).all()
        assert len(lengths) == len(rules) and all(lengths[k] == len(repair.expand(np.array([50257 + k]), rules, 50257)) for k in range(len(rules)))
        _, counts = np.unique(symbols[:-1] * 2**32 + symbols[1:], return_counts=True)
        assert not len(counts) or counts.max() < repair.LEAST


def test_shards_with_many_symbols():
    ids = np.random.default_rng(3).permutation(np.repeat(np.arange(9000), 2))
    ids = np.tile(np.concatenate([ids, np.arange(8000) * 7]), 6)
    shard = Shard.unpack(pack([1], [ids], 60_000))
    assert len(shard.rules) > 2**16 - 60_000 and (shard.all_ids() == ids).all() and (shard.read(5000, 77) == ids[5000:5077]).all()


def test_library_chunks_of_any_kind():
    from voxelstream.llm.tokenizing import LibraryTokenizer

    library, rng = Tokenizer.from_file(JSON), random.Random(4)
    texts = ["".join(rng.choices("abé'_.,!?$9 \n\tA-中٣", k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["x don't. 'tis we're!! a'b c_d. _x <|endoftext|>. a<|endoftext|> b", "", " ", "a  b ", "　x 　 y"]
    texts += ["\x85 a\x85 b", "a\x1c b\x1f c", "a\u2003 b", "a\ufeff b", "a\u200b b", "", "a"]
    own, want = LibraryTokenizer(open(JSON, "rb").read()), [library.encode(t, add_special_tokens=False).ids for t in texts]
    for some in (pa.array(texts), pa.array(["x", *texts, "y"])[1:-1]):
        flat, sizes = own.encode(some)
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


def test_tables_share_a_cache(spark, docs, rows, tmp_path, monkeypatch):
    """What one table brought isn't encoded for another; of contents that both lack one copy is."""
    seen = []
    plain = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda misses, *a: (seen.append(sorted(r["text"] for r in misses.collect())), plain(misses, *a))[1])
    file, cache = JSON, f"{tmp_path}/cache"
    first = token_counts.token_counts(docs, file, cache).collect()
    again = token_counts.token_counts(docs, file, cache).collect()
    more = spark.createDataFrame([*rows[:5], (900, "not yet seen"), (None, "not yet seen"), (901, "not yet seen"), (901, "not yet seen")], "doc_id long, text string")
    other = token_counts.token_counts(more, file, cache).collect()
    assert seen == [sorted({t or "" for _, t in rows}), [], ["not yet seen"]]
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(other) == 9 and {r["n_tokens"] for r in other[-4:]} != {0}


def test_distinct_words_cost_no_python():
    """Words go to the library's model many at a time, not one by one."""
    from voxelstream.llm.tokenizing import LibraryTokenizer

    own, rng, calls = LibraryTokenizer(open(JSON, "rb").read()), random.Random(6), [0]
    own.encode(pa.array(["first"]))
    words = ["".join(rng.choices("etaoinshé", k=7)) for _ in range(20_000)]
    texts = pa.array([" ".join(words[k : k + 100]) + "." for k in range(0, len(words), 100)])

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        flat, sizes = own.encode(texts)
    finally:
        sys.setprofile(None)
    library = Tokenizer.from_file(JSON)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
    assert calls[0] < len(words) / 4


@pytest.mark.parametrize("cut", [20, 1 << 20])
def test_matches_of_all_classes(monkeypatch, cut):
    from voxelstream.llm import tokenizing

    monkeypatch.setattr(tokenizing, "CUT_BYTES", cut)
    library, rng = Tokenizer.from_file(JSON), random.Random(7)
    own = tokenizing.LibraryTokenizer(open(JSON, "rb").read())
    texts = ["".join(rng.choices("aé's'tmdrevl1٣ \n\t\u3000\xa0-!.中😀 ", k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{c}1{c} {c}!{c}{c}b" for c in map(chr, range(0, 0x2FFF))] + ["'", "'s", "a'r", "''s", "a'll", "<|endoftext|>", "a <|endoftext|>'s b", "", "ab" * 900]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, sizes = own.encode(pa.array(texts))
    assert own.cuts_matches and sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
