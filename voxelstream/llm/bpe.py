"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Each distinct word of a batch is an array of bytes that is folded once by
ranked merges: the leftmost pair of lowest rank becomes one piece, until no pair has a rank. All words of a batch are
folded side by side in NumPy. The rank map (a file of bounded size) is broadcast. Decoding turns ids back into their
binary pieces and concatenates those.

``bpe_native`` has the same fold in Spark's higher-order functions.

Defined results: null and empty texts have no ids, and decode to nothing; repeated rows each get their row; a
null doc_id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, slices, text_or_empty
from .tokenizing import TAIL, Ids, PieceEncoder, by_bytes, gathered

WIDTHS = (8, 12, 16, 24, 48)  # bytes of words that are folded together; longer ones are folded with a heap
STEP = 4096  # words folded together, at most
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(file_bytes(path))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Bpe:
    """Ranked merges of words, and whole texts by a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self._cut = ranks, regex.compile(pattern).findall
        self._plain = pattern == public_tokenizers.PATTERN  # for which words of letters are known without a match
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.names = [str(i) for i in range(len(self.pieces))]
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[x[:i]] << 32) | ranks[x[i:]]: r for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks}
        self._keys = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        self._maybe = np.zeros(1 << 22, bool)  # rules most pairs out before they are looked up
        self._maybe[self._slot(self._keys)] = True
        self._encoder = PieceEncoder(self._of_chunks, lambda texts: self._of_words([self._cut(t) for t in texts]))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, NONE for those that do not merge."""
        keys = (left << 32) | right
        found = np.full(keys.shape, NONE)
        places = np.flatnonzero(self._maybe[self._slot(keys)])
        if len(places) and len(self._keys):
            wanted = keys[places]
            at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
            real = self._keys[at] == wanted
            found[places[real]] = self._merged[at[real]]
        return found

    def _fold(self, words: list[bytes], width: int) -> Ids:
        """Ids of words of at most ``width`` bytes: in every step the leftmost pair of lowest rank of each word becomes one piece."""
        n = len(words)
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        sizes = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width)
        piece, alive = self._bytes[data], place < sizes[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        rank = np.full((n, width), NONE)
        inner = place[None, :-1] + 1 < sizes[:, None]
        rank[:, :-1][inner] = self._rank(piece[:, :-1][inner], piece[:, 1:][inner])
        rows = np.arange(n)
        while len(rows):
            held = rank[rows]
            at = held.argmin(axis=1)
            lowest = held[np.arange(len(rows)), at]
            more = lowest < NONE
            rows, at = rows[more], at[more]
            gone = after[rows, at]
            piece[rows, at], alive[rows, gone], rank[rows, gone] = lowest[more], False, NONE
            then, prior = after[rows, gone], before[rows, at]
            after[rows, at] = then
            has_next, has_prior = then < sizes[rows], prior >= 0
            before[rows[has_next], then[has_next]] = at[has_next]
            rank[rows, at] = NONE
            r, j = np.concatenate([rows[has_next], rows[has_prior]]), np.concatenate([at[has_next], prior[has_prior]])
            rank[r, j] = self._rank(piece[r, j], piece[r, after[r, j]])
        return piece[alive].astype(np.uint32), alive.sum(axis=1)

    def fold(self, words: list[bytes]) -> Ids:
        """Ids of words, one after the other."""
        runs: list[tuple[np.ndarray, Ids]] = []
        known = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        whole = np.flatnonzero(known >= 0)
        runs.append((whole, (known[whole].astype(np.uint32), np.ones(len(whole), np.int64))))
        sizes = np.where(known >= 0, 0, np.fromiter(map(len, words), np.int64, len(words)))
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(some), STEP):
                part = some[at : at + STEP]
                runs.append((part, self._fold([words[k] for k in part.tolist()], width)))
        long = np.flatnonzero(sizes > WIDTHS[-1])
        lists = [self._fold_long(words[k]) for k in long.tolist()]
        runs.append((long, (np.array([i for ids in lists for i in ids], np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))))
        order = np.concatenate([k for k, _ in runs])
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(order))
        flat, n = (np.concatenate(x) for x in zip(*(ids for _, ids in runs), strict=True))
        return gathered(flat, n, number), n[number]

    def _of_words(self, cut: list[list[str]]) -> Ids:
        """Ids of texts that are cut into words; each distinct word is folded once."""
        numbers: dict[str, int] = {}
        number = np.fromiter((numbers.setdefault(w, len(numbers)) for words in cut for w in words), np.int64)
        flat, sizes = self.fold([w.encode() for w in numbers])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        upto = np.append(0, np.cumsum(sizes[number]))[np.append(0, ends)]
        return gathered(flat, sizes, number), np.diff(upto)

    def _of_chunks(self, chunks: list[str]) -> Ids:
        """Ids of " " + chunk for each: a word of letters, such a word and a tail that the pattern takes as one, or any other."""
        cut = []
        for chunk in chunks:
            if self._plain and chunk.isalpha():
                cut.append([f" {chunk}"])
                continue
            core = chunk.rstrip(TAIL)
            cut.append([f" {core}", chunk[len(core) :]] if self._plain and core.isalpha() else self._cut(f" {chunk}"))
        return self._of_words(cut)

    def _fold_long(self, word: bytes) -> list[int]:
        """The same merges with a heap over linked pieces, for words of any length."""
        of, n = self.ranks.get, len(word)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue
            ends[i], alive[j], after[i] = end, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := of(word[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if before[i] >= 0 and (r := of(word[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        return [self.ranks[word[i : ends[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts."""
        flat, sizes = self._encoder.encode(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def kept_bpe(content: bytes, pattern: str) -> Bpe:
    """The merges of a rank file; a Python worker keeps them for its next tasks."""
    return Bpe(parse_ranks(content), pattern)


def _each(docs: DataFrame, rank_file: str, pattern: str, columns: str, rows) -> DataFrame:
    """doc_id and what ``rows(bpe, texts)`` gives as Arrow arrays for each slice of texts."""
    content = docs.sparkSession.sparkContext.broadcast(file_bytes(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_bpe(content.value, pattern)
        for batch in by_bytes(batches):
            arrays = rows(bpe, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *(c.split()[0] for c in columns.split(", "))])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return typed.mapInArrow(run, f"doc_id long, {columns}")


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids of its whole text."""
    return _each(docs, rank_file, pattern, "ids array<long>", lambda bpe, texts: [pa.array([ids.astype(np.int64) for ids in bpe.encode(texts)], pa.list_(pa.int64()))])


def decode_documents(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids) -> doc_id and the bytes they stand for."""
    content = encoded.sparkSession.sparkContext.broadcast(file_bytes(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_bpe(content.value, "")
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(i) for i in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""

    def rows(bpe: Bpe, texts: pa.Array) -> list[pa.Array]:
        n, encoded, decoded = [], [], []
        for found in bpe.encode(texts):
            ids = found.tolist()
            n.append(len(ids))
            encoded.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]

    return _each(docs, rank_file, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
