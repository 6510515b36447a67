"""Tokenizing whole texts by the distinct pieces of a batch.

In the byte-level pattern a space after a non-space character always begins a new match, and no look-ahead crosses
it. So a text's ids are those of its pieces cut before each such space, in order. Arrow cuts the texts of a batch and
numbers their distinct pieces; only those are encoded, and NumPy puts the ids of the texts together. Texts with other
white space before a space are encoded whole.

A tokenizers file of byte-level pairs goes further: classes of characters cut texts into the pattern's matches, in
NumPy, and the library's model gets the distinct matches of a batch, many at a time.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import give_back

BATCH_BYTES = 2 << 20  # bytes of text whose distinct pieces are found together
CUT_BYTES = 1 << 20  # bytes of text that are cut into matches together
JOINED = 64  # matches that the library's model gets as one text
AT_ONCE = 32  # such texts that it gets in one call, which holds far more than their ids

SPACE, LETTER, NUMBER, OTHER = range(4)  # classes of characters in the pattern
BREAK = 0xFF  # a byte that no UTF-8 text has

#: Characters that are neither white space, letters nor digits, and begin no contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

Ids = tuple[np.ndarray, np.ndarray]  # ids of several texts one after the other, and how many each has


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each has about ``size`` bytes of text, or one row."""
    for batch in batches:
        yield from by_size(batch, column, size)
    give_back()


def by_size(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    part = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) // size
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(at, end - at)


def gathered(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these numbers, one after the other; ``sizes`` are the lengths of all its runs."""
    starts, lengths = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    index = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    index += np.arange(total, dtype=kind)
    return flat[index]


class PieceEncoder:
    """Ids of texts from ``of_chunks`` (those of " " + chunk for each) and ``of_texts`` (those of whole texts)."""

    def __init__(self, of_chunks: Callable[[list[str]], Ids], of_texts: Callable[[list[str]], Ids]):
        self._of_chunks, self._of_texts = of_chunks, of_texts

    def encode(self, texts: pa.Array) -> Ids:
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        found = cut.flatten().dictionary_encode()
        pieces, number = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
        # Arrow's white space is that of the pattern, and control characters besides.
        length = pc.binary_length(found.dictionary).to_numpy()
        alone = (length > 0) & (pc.binary_length(pc.utf8_rtrim_whitespace(found.dictionary)).to_numpy() == length)
        # A text is encoded whole if a piece of it does not stand alone.
        whole = np.add.reduceat((~alone[number]).astype(np.int64), offsets[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        heads = np.zeros(len(number), bool)
        heads[offsets[:-1]] = True
        of_whole = np.repeat(whole, np.diff(offsets))
        parts, sizes = [], []

        def known(encode: Callable[[list[str]], Ids], some: np.ndarray) -> np.ndarray:
            """Encode these pieces; the place of each piece among all that is encoded."""
            flat, n = encode([pieces[k] for k in some.tolist()])
            place = np.full(len(pieces), -1)
            place[some] = sum(map(len, sizes)) + np.arange(len(some))
            parts.append(flat)
            sizes.append(n)
            return place

        as_chunk = known(self._of_chunks, np.unique(number[~heads & ~of_whole]))
        as_head = known(self._of_texts, np.unique(number[heads & ~of_whole]))
        flat, n = self._of_texts([texts[k].as_py() for k in np.flatnonzero(whole).tolist()])
        run = np.where(heads, as_head[number], as_chunk[number])
        # A whole text is one run, in the place of its head.
        run[offsets[:-1][whole]] = sum(map(len, sizes)) + np.arange(int(whole.sum()))
        keep = heads | ~of_whole
        all_sizes = np.concatenate([*sizes, n])
        out = gathered(np.concatenate([*parts, flat]), all_sizes, run[keep])
        lengths = np.where(keep, all_sizes[run], 0)
        return out, np.add.reduceat(lengths, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)


def packed(runs: list[bytes]) -> Ids:
    """Runs of little-endian uint32 ids."""
    return np.frombuffer(b"".join(runs), "<u4"), np.fromiter(map(len, runs), np.int64, len(runs)) // 4


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, those in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(those, every):
            out[run.start() : run.end()] = kind
    return out


def _shares(text: pa.Array) -> Iterator[pa.Array]:
    """One long text in shares of CUT_BYTES or more, which begin with a blank after a letter, and so with a match."""
    data = text[0].as_buffer()
    at, end = 0, min(CUT_BYTES, len(data))
    while at < len(data):
        found = re.compile(rb"[A-Za-z](?= )").search(data, end)
        end = found.end() if found else len(data)
        yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - at], np.int32)), data[at:end])
        at, end = end, min(end + CUT_BYTES, len(data))


def cut_in_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As ``cut_matches``, for about CUT_BYTES at a time, which bounds what the cuts need besides the matches."""
    matches, counts = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
    for part in by_size(pa.RecordBatch.from_arrays([texts], ["text"]), "text", CUT_BYTES):
        column = part.column("text")
        found = [cut_matches(x) for x in (_shares(column) if len(column) == 1 else [column])]
        matches += [m for m, _ in found]
        counts.append(found[0][1] if len(column) > 1 else np.array([sum(len(m) for m, _ in found)]))
    return pa.concat_arrays(matches), np.concatenate(counts)


def cut_matches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the byte-level pattern's matches in all texts, in order; how many each text has). No text is null."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    place = np.flatnonzero((data & 0xC0) != 0x80)  # of each character, in bytes
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    of_text, n = np.searchsorted(place, bounds), len(points)
    first = np.zeros(n + 1, bool)
    first[of_text] = True
    kind = _classes()[points]
    space = kind == SPACE
    # A match is a run of a class and the blank before it. Of white space before it the last character stands alone.
    starts = first.copy()
    starts[1:n] |= (kind[1:] != kind[:-1]) & (points[:-1] != 0x20)
    starts[: n - 1] |= space[:-1] & ~space[1:] & ~first[1:n]
    # 's 't 'm 'd 're 've 'll, where a match begins at the apostrophe and so at what follows.
    at = np.flatnonzero(points == 0x27)
    at = at[starts[at] & ~first[at + 1]]
    one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= ~first[np.minimum(at + 2, n)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    starts[at[short | long] + 1] = False
    starts[at[short] + 2] = True
    starts[at[long] + 3] = True
    found = np.flatnonzero(starts[:n])
    offsets = np.append(place[found], len(data)).astype(np.int32)
    matches = pa.StringArray.from_buffers(len(found), pa.py_buffer(offsets), pa.py_buffer(data))
    return matches, np.diff(np.searchsorted(found, of_text))


class LibraryTokenizer:
    """A tokenizers file: ids of texts, exactly as the library gives them.

    With ``plain`` the strings of special tokens are text like any other.
    """

    def __init__(self, content: bytes, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content.decode())
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = plain
        self.size = self._tokenizer.get_vocab_size()
        settings = json.loads(content)
        pre = settings.get("pre_tokenizer") or {}
        #: Only a plain byte-level tokenizer cuts at spaces as PieceEncoder needs it.
        self.cuts_at_spaces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not settings.get("normalizer")
        self._special = [] if plain else [t["content"] for t in settings.get("added_tokens", ())]
        self._model = Tokenizer(self._tokenizer.model)  # without the cuts
        self._break = self._tokenizer.token_to_id(chr(BREAK))
        self._characters = np.array([BYTE_CHARACTERS.get(b, b) for b in range(256)], "<u4")
        self.cuts_matches = self.cuts_at_spaces and pre.get("use_regex", True) and self._keeps_breaks(settings["model"])

    def _keeps_breaks(self, model: dict) -> bool:
        """Whether the model never joins a BREAK with what stands beside it, and looks at nothing but pairs."""
        pairs = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return pairs and self._break is not None and not any(chr(BREAK) in t and len(t) > 1 for t in model["vocab"])

    def vocabulary(self) -> dict[str, int]:
        return self._tokenizer.get_vocab()

    def of_texts(self, texts: list[str]) -> Ids:
        return packed([array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else [])

    def encode(self, texts: pa.Array) -> Ids:
        if not self.cuts_matches:
            return self.of_texts(texts.to_pylist())
        # Texts with special strings are encoded whole.
        whole = np.zeros(len(texts), bool)
        for special in self._special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        cut = texts if not len(at) else pc.if_else(pa.array(whole), "", texts)
        matches, count = cut_in_parts(cut.cast(pa.string()))
        found = matches.dictionary_encode()
        number = found.indices.to_numpy().astype(np.int64)
        flat, sizes = self.of_matches(found.dictionary)
        if len(at):
            more, n = self.of_texts([texts[k].as_py() for k in at.tolist()])
            number = np.insert(number, (np.cumsum(count) - count)[at], len(sizes) + np.arange(len(at)))
            flat, sizes, count[at] = np.concatenate([flat, more]), np.concatenate([sizes, n]), 1
        ends = np.cumsum(count)
        total = np.append(0, np.cumsum(sizes[number]))
        return gathered(flat, sizes, number), total[ends] - total[ends - count]

    def of_matches(self, matches: pa.Array) -> Ids:
        """Ids of matches of the pattern, from the library's model: JOINED of them at a time, each with a BREAK."""
        if not len(matches):
            return packed([])
        ended = pc.binary_join_element_wise(matches.cast(pa.binary()), b"", bytes([BREAK]))
        ends = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset :][: len(ended) + 1]
        text = self._characters[np.frombuffer(ended.buffers()[2], np.uint8)[ends[0] : ends[-1]]].tobytes().decode("utf-32-le")
        cuts = [*(ends[:-1:JOINED] - ends[0]).tolist(), len(text)]
        parts = [text[a:b] for a, b in itertools.pairwise(cuts)]
        calls = (self._model.encode_batch_fast(parts[k : k + AT_ONCE], add_special_tokens=False) for k in range(0, len(parts), AT_ONCE))
        flat, _ = packed([array("I", e.ids).tobytes() for call in calls for e in call])
        breaks = flat == self._break
        return flat[~breaks], np.diff(np.flatnonzero(breaks), prepend=-1) - 1


@functools.lru_cache(maxsize=1)
def library_tokenizer(content: bytes, plain: bool = False) -> LibraryTokenizer:
    """The tokenizer of a file; a Python worker keeps it, with what it has learnt, for its next tasks."""
    return LibraryTokenizer(content, plain)
