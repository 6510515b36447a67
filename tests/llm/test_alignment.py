"""Tokenizer alignment against byte intervals from the libraries' ids of whole texts."""

import hashlib
from bisect import bisect_left
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from voxelstream.llm import alignment
from voxelstream.llm.tokenizing import BYTE_CHARACTERS

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", " a", "a ", "▁x", "x ▁ y", "<|endoftext|> a<|endoftext|>", "a<s>b </s> <unk>", "a\n b\t c", "ﬁ ① ¨x é é", "ab\x00c \x1c d", "日本語 テキスト 日本", "🙂 🙂x", "a b 　c", "x" * 3000, "ab " * 2000, "\n\n\n", "a\r\n b"]


def brute(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {chr(c): b for b, c in BYTE_CHARACTERS.items()}
    a_bytes = lambda i: bytes(byte_of.get(c, ord(c)) for c in t.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for doc, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        left, right = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(left) != f" {text}".encode() or b"".join(right) != f" {text}".encode():
            found.append((doc, [], [], [], ""))
            continue
        spans = []
        for parts in (left, right):
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], [0, 0]
        for cut in cuts:
            after = [bisect_left(own, (cut, 0)) for own in spans]
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), before, after, strict=True)))
            before = after
        found.append((doc, a, b, links, ";".join(groups)))
    count = Counter(x for f in found for x in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (d, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, a, b, links, g in found
    ]


def same(df, rows):
    got = alignment.alignments(df, A, B)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("hot", [alignment.HOT, 5, 0])
def test_odd_texts(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    more = [(1000 + k, t) for k, t in enumerate(ODD)] + [(1003, "a  b")]
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("batch", "pair", "n", "best", "run", "links", "i")})
    same(docs.unionByName(extra, allowMissingColumns=True), rows + more)


def test_whole_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty(spark, empty):
    assert alignment.alignments(empty, A, B).count() == 0
    same(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), [(1, None), (None, "")])


def test_transducer():
    """States are the leading side and what it leads by; a group closes when nothing is left over."""
    a, b = [b"ab", b"c", b"def", b"g"], [b"a", b"bcd", b"ef", b"h"]
    own = alignment.Transducer(a, b)
    assert own.step(0, b"ab", 0) == (0, b"b") and own.step(0, b"b", 1) == (1, b"cd") and own.step(1, b"cd", 1) == (1, b"d")
    assert own.align([0, 1, 2], [0, 1, 2]) == ([0, 0, 1, 2, 2], [0, 1, 1, 1, 2], [3], [3], [5])
    assert own.align([1, 0, 0], []) is None and own.align([3], [3]) is None and own.align([0], [0]) is None and own.align([], [0]) is None
    assert own.align([], []) == ([], [], [], [], [])


def test_pieces_alike_with_and_without_what_is_kept(monkeypatch):
    """Texts by pieces, in passes of any size, as whole texts."""
    texts = ["a b, c", "it's über-ding. x", "don't <|endoftext|> a\nb .", "日本 日本 é"] * 2
    own = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    for together, kept in ((1, 2), (3, 0), (256, 10)):
        monkeypatch.setattr(alignment, "TOGETHER", together)
        monkeypatch.setattr(alignment, "KEPT", kept)
        for text in texts:
            pieces = own.pieces(text.split(" "))
            whole = own.text(text)
            assert (";".join(p[0] for p in pieces), b"".join(p[1] for p in pieces), *(sum(p[k] for p in pieces) for k in (2, 3, 4))) == whole
