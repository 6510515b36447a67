"""Alignment of two tokenizers over the same bytes by a dangling-suffix transducer.

The transducer's state is which side leads and the bytes of its last token that the other has not matched yet; the
lagging side's next token either leaves a shorter residual, or takes the lead with its own, or empties it, which closes
a group. Transitions are memoised by residual and next token. Each step is one link: the token read overlaps the last
token of the leading side, and no other pair overlaps.

Both tokenizers start a token at a space that follows a non-space, so the residual is empty there: the transducer runs
over the distinct pieces of a batch, NumPy puts texts together. Texts with other white space before a space, or with
spaces in a row, are aligned whole.

How often a pair of ids is linked is counted over all documents, in a table as large as the corpus makes it. The HOT
most frequent pairs are broadcast and looked up where the batches are; all others are joined by pair, none of which
then has more than 1/HOT of all links.

Defined results: null and empty texts, and texts that one of the sides doesn't keep byte by byte (U+2581 is a space to
the second), have no tokens: zeros, and an empty digest. Repeated rows each count and each get their row; a null doc_id
stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, give_back, materialize, text_or_empty
from .tokenizing import BYTE_CHARACTERS, by_bytes, gathered, library_tokenizer

HOT = 65_536  # pairs that are broadcast with their counts
TRANSITIONS = 200_000  # transitions that a worker keeps
BATCH_BYTES = 4 << 20  # of text whose distinct pieces are found together
ROW_BYTES = 256 << 10  # of text in a stored row
KEPT = 60_000  # pieces met lately that a worker keeps, and as many before
TOGETHER = 256  # pieces that the transducer reads in one pass

#: Of each document: id, numbers and digest, and how many pieces it has; of the batch: pieces by number one after the
#: other, and of each distinct piece how many links it has, and these. The last four are packed: they are long.
BATCH = "doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, n_pieces binary, run binary, n_links binary, links binary"
PACKED = {"n_pieces": np.int32, "run": np.int32, "n_links": np.int32}


@dataclass
class Keys:
    """How a pair of ids is written as one number: the second id takes ``shift`` bits, all of it a ``kind``."""

    shift: int
    kind: str

    @staticmethod
    def of(n_a: int, n_b: int) -> Keys:
        a, b = ((n - 1).bit_length() for n in (n_a, n_b))
        return Keys(b, "<u4" if a + b <= 32 else "<i8")

    def packed(self, left: list[int], right: list[int]) -> bytes:
        return (np.array(left, np.int64) << self.shift | np.array(right, np.int64)).astype(self.kind).tobytes()


class Transducer:
    """Groups and links of two token sequences, whose tokens are given as their bytes by id.

    A state is who leads and the bytes it leads by. States are numbered, even where the first side leads; state 0 has
    nothing left over. Transitions are kept by state and next token.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self._bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self._number: dict[tuple[int, bytes], int] = {}
        self._states: list[tuple[int, bytes] | None] = [None, None]
        self._next: dict[int, int] = {}

    def _state(self, lead: int, residual: bytes) -> int:
        if not residual:
            return 0
        if (lead, residual) not in self._number:
            self._number[lead, residual] = len(self._states) + lead
            self._states += [(lead, residual)] * 2
        return self._number[lead, residual]

    def step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """(who leads, what it leads by) after the other side's ``token``; None if bytes differ."""
        read = self._bytes[1 - lead][token]
        if residual.startswith(read):
            return lead, residual[len(read) :]
        return (1 - lead, read[len(residual) :]) if read.startswith(residual) else None

    def _first(self, state: int, token: int) -> int:
        """A transition that isn't kept yet; -1 where bytes differ."""
        after = self.step(*self._states[state], token)
        number = self._next[state << 17 | token] = -1 if after is None else self._state(*after)
        return number

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]] | None:
        """(first ids, second ids) of the links, and where each group ends in ``a``, in ``b`` and in the links.

        None where the sides' bytes differ.
        """
        if len(self._next) > TRANSITIONS:
            self.forget()
        onward, first, start, a_bytes = self._next.get, self._first, self._state, self._bytes[0]
        left, right, ends_a, ends_b, ends = [], [], [], [], []
        i = j = 0
        try:
            while i < len(a):
                of_a = a[i]
                i += 1
                state, of_b = start(0, a_bytes[of_a]), -1
                while state:
                    if state & 1:
                        token = of_a = a[i]
                        i += 1
                    else:
                        token = of_b = b[j]
                        j += 1
                    left.append(of_a)
                    right.append(of_b)
                    after = onward(state << 17 | token)
                    state = first(state, token) if after is None else after
                    if state < 0:
                        return None
                ends_a.append(i)
                ends_b.append(j)
                ends.append(len(left))
        except IndexError:  # one side ends before the other
            return None
        return (left, right, ends_a, ends_b, ends) if j == len(b) else None


LEAD = "a"
LETTERS = regex.compile(r"\p{L}+").match
MIXED = regex.compile(r"\p{L}[^\p{L}▁]|[^\p{L}▁]\p{L}").search

Piece = tuple[str, bytes, int, int, int]  # groups as text, keys of the links, tokens of each side, number of groups


def _joined(word: Piece | None, rest: Piece | None, wide: int) -> Piece | None:
    """A word, and what follows ``LEAD`` in a piece; a link takes ``wide`` bytes."""
    if word is None or rest is None:
        return None
    return f"{word[0]};{rest[0].partition(';')[2]}", word[1] + rest[1][wide:], word[2] + rest[2] - 1, word[3] + rest[3] - 1, word[4] + rest[4] - 1


class Aligner:
    """Pieces and texts, aligned: a ``tokenizers`` file reads " " + text, a sentencepiece model adds the space itself."""

    def __init__(self, a_content: bytes, b_content: bytes):
        import sentencepiece

        self._a = library_tokenizer(a_content, True)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        byte_of = {chr(c): b for b, c in BYTE_CHARACTERS.items()}
        by_id = {i: piece for piece, i in self._a.vocabulary().items()}
        a_bytes = [bytes(byte_of.get(c, ord(c) & 255) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._bytes = (a_bytes, b_bytes)
        self._starts = tuple(np.array([x.startswith(b" ") for x in own]) for own in self._bytes)
        self._transducer = Transducer(a_bytes, b_bytes)
        self.keys = Keys.of(len(a_bytes), len(b_bytes))
        self._known: dict[str, Piece | None] = {}
        self._older: dict[str, Piece | None] = {}
        self._names = [str(i) for i in range(max(map(len, self._bytes)))]
        #: Both cut at a space that follows a non-space.
        #: Neither has tokens of letters and what is none, so both also cut after letters; LEAD is a token by itself.
        self._cuts_words = self._a.cuts_at_spaces and not any(not self._b.is_control(i) and not self._b.is_unknown(i) and not self._b.is_byte(i) and MIXED(p) for i, p in enumerate(pieces))
        self._cuts_words = self._cuts_words and (own := self.text(LEAD)) is not None and own[2:] == (1, 1, 1)
        self._cuts = self._a.cuts_at_spaces and not any("▁" in p.lstrip("▁") for p in pieces)

    def forget(self) -> None:
        """Give up what was kept: a worker goes on to other stages."""
        self._known, self._older = {}, {}
        self._transducer.forget()

    def _groups(self, a: list[int], b: list[int], found: tuple) -> list[str]:
        """Each group as text."""
        out, x, y, names = [], 0, 0, self._names
        for end_a, end_b in zip(found[2], found[3], strict=True):
            if end_a - x == 1 and end_b - y == 1:
                out.append(f"{a[x]}|{b[y]}")
            else:
                out.append(f"{','.join([names[k] for k in a[x:end_a]])}|{','.join([names[k] for k in b[y:end_b]])}")
            x, y = end_a, end_b
        return out

    def _together(self, pieces: list[str]) -> list[Piece | None]:
        """Pieces without spaces and U+2581, in one pass of the transducer: no group crosses their borders."""
        a = self._a.of_texts([f" {' '.join(pieces)}"])[0]
        b = np.array(self._b.encode(" ".join(pieces)), np.int64)
        heads = [np.flatnonzero(starts[ids]) for starts, ids in zip(self._starts, (a, b), strict=True)]
        a, b = a.tolist(), b.tolist()
        found = self._transducer.align(a, b)
        if found is None or any(len(h) != len(pieces) for h in heads):
            return [self.text(p) for p in pieces]
        groups, links, wide = self._groups(a, b, found), self.keys.packed(found[0], found[1]), np.dtype(self.keys.kind).itemsize
        g = [0, *np.searchsorted(found[2], [*heads[0][1:].tolist(), len(a)], "right").tolist()]
        n_a, n_b = (np.diff(np.append(h, len(ids))).tolist() for h, ids in zip(heads, (a, b), strict=True))
        ends = [0, *found[4]]
        return [(";".join(groups[x:y]), links[wide * ends[x] : wide * ends[y]], n, m, y - x) for x, y, n, m in zip(g[:-1], g[1:], n_a, n_b, strict=True)]

    def pieces(self, some: list[str]) -> list[Piece | None]:
        """Each piece aligned after a space, or None; what was met lately is kept."""
        if len(self._known) > KEPT:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        # A word, and what follows its letters: both sides cut there. The word is ``LEAD`` where only the rest is wanted.
        cut = [(p[: m.end()], LEAD + p[m.end() :]) if self._cuts_words and (m := LETTERS(p)) and m.end() < len(p) else (p, None) for p in some]
        wanted = dict.fromkeys([x for pair in cut for x in pair if x is not None])
        for p in wanted:
            if p not in known and p in older:
                known[p] = older[p]
        new = [p for p in wanted if p not in known]
        known.update(dict.fromkeys([p for p in new if "▁" in p]))
        new = [p for p in new if "▁" not in p]
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            known.update(zip(part, self._together(part), strict=True))
        wide = np.dtype(self.keys.kind).itemsize
        return [known[word] if rest is None else _joined(known[word], known[rest], wide) for word, rest in cut]

    def text(self, text: str) -> Piece | None:
        a, b = self._a.of_texts([f" {text}"])[0].tolist(), self._b.encode(text)
        found = self._transducer.align(a, b)
        if found is None or b"".join([self._bytes[0][i] for i in a]) != f" {text}".encode():
            return None
        return ";".join(self._groups(a, b, found)), self.keys.packed(found[0], found[1]), len(a), len(b), len(found[2])

    def batch(self, texts: pa.Array) -> tuple[list[Piece | None], np.ndarray, np.ndarray]:
        """(pieces, run, n_pieces): the distinct pieces, and the numbers of those of each text in order.

        A text without tokens has no pieces.
        """
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        found = cut.flatten().dictionary_encode()
        length = pc.binary_length(found.dictionary).to_numpy()
        alone = (length > 0) & (pc.binary_length(pc.utf8_rtrim_whitespace(found.dictionary)).to_numpy() == length) & self._cuts
        number = found.indices.to_numpy().astype(np.int64)
        whole = np.add.reduceat((~alone[number]).astype(np.int64), offsets[:-1]) > 0
        of_whole = np.repeat(whole, np.diff(offsets))
        used = np.zeros(len(alone), bool)
        used[number[~of_whole]] = True
        some = np.flatnonzero(used).tolist()
        distinct, pieces = found.dictionary.to_pylist(), [None] * len(alone)
        for k, piece in zip(some, self.pieces([distinct[k] for k in some]), strict=True):
            pieces[k] = piece
        bad = np.fromiter((p is None for p in pieces), bool, len(pieces))
        lost = np.add.reduceat((bad[number] & ~of_whole).astype(np.int64), offsets[:-1]) > 0
        n_pieces = np.where(lost | whole, 0, np.diff(offsets))
        run = number[np.repeat(~lost & ~whole, np.diff(offsets))]
        aligned = {k: p for k in np.flatnonzero(whole).tolist() if texts[k].as_py() and (p := self.text(texts[k].as_py())) is not None}
        run = np.insert(run, (np.cumsum(n_pieces) - n_pieces)[list(aligned)], np.arange(len(pieces), len(pieces) + len(aligned)))
        n_pieces[list(aligned)] = 1
        return [*pieces, *aligned.values()], run, n_pieces


@functools.lru_cache(maxsize=1)
def aligner(a_content: bytes, b_content: bytes) -> Aligner:
    """A Python worker keeps it, with what it has learnt, for its next tasks."""
    return Aligner(a_content, b_content)


def _totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes, some of which are empty."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return ends[at[1:]] - ends[at[:-1]]


def _one_row(schema: list[str], columns: list) -> pa.RecordBatch:
    """A row of these values, lists or packed."""
    kinds, cells = {"array<bigint>": pa.int64(), "array<string>": pa.string()}, []
    for (name, kind), column in zip(map(str.split, schema), columns, strict=True):
        if kind == "binary":
            cells.append(pa.array([column if isinstance(column, bytes) else column.astype(PACKED[name]).tobytes()], pa.binary()))
        else:
            values = column if isinstance(column, pa.Array) else pa.array(column, kinds[kind])
            cells.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(cells, names=[f.split()[0] for f in schema])


def aligned_batches(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """One row for each batch of documents: their pieces, and the links of each distinct piece. Written once."""
    sc = docs.sparkSession.sparkContext
    content, schema = sc.broadcast((file_bytes(a_file), file_bytes(b_file))), BATCH.split(", ")

    def rows(own: Aligner, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A batch is aligned at once; what is stored of it are smaller rows, each with the pieces of its own documents."""
        pieces, run, n_pieces = own.batch(batch.column("text"))
        upto, wide = np.append(0, np.cumsum(n_pieces)), np.dtype(own.keys.kind).itemsize
        part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // ROW_BYTES
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for first, last in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            there, own_run = np.unique(run[upto[first] : upto[last]], return_inverse=True)
            some, n = [pieces[k] for k in there.tolist()], n_pieces[first:last]
            numbers = np.array([p[2:] for p in some], np.int64).reshape(-1, 3)
            sums = [_totals(numbers[own_run, k], n) for k in range(3)]
            texts, ends = [p[0] for p in some], [0, *np.cumsum(n).tolist()]
            digests = [hashlib.sha256(";".join([texts[k] for k in own_run[a:b].tolist()]).encode()).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]
            links = [p[1] for p in some]
            n_links = np.fromiter(map(len, links), np.int64, len(links)) // wide
            yield _one_row(schema, [batch.column("doc_id").slice(first, last - first), *sums, digests, n, own_run, n_links, b"".join(links)])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in by_bytes(batches, size=BATCH_BYTES):
            own = own or aligner(*content.value)
            yield from rows(own, batch)
        if own:
            own.forget()
        give_back()

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(typed.mapInArrow(align, BATCH).withColumn("batch", F.monotonically_increasing_id()), "aligned", **{"parquet.block.size": 4 << 20, "parquet.enable.dictionary": "false", "compression": "zstd"})


def _unpacked(batch: pa.RecordBatch, row: int, keys: Keys, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(n)[row].as_buffer(), PACKED.get(n, keys.kind)) for n in names]


def pair_counts(aligned: DataFrame, keys: Keys) -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether none of its second id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                run, n_links, links = _unpacked(batch, row, keys, "run", "n_links", "links")
                often = np.repeat(np.bincount(run, minlength=len(n_links)), n_links)
                pair, where = np.unique(links, return_inverse=True)
                n = np.bincount(where, weights=often, minlength=len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])
        give_back()

    found = aligned.select("run", "n_links", "links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = materialize(found.withColumn("b", F.col("pair").bitwiseAND((1 << keys.shift) - 1)), "pair-counts")
    most = found.groupBy("b").agg(F.max("n").alias("most"))
    return found.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


DOCUMENT = "i int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _keys(a_file: str, b_file: str) -> Keys:
    import sentencepiece
    from tokenizers import Tokenizer

    n_a = max(Tokenizer.from_str(file_bytes(a_file).decode()).get_vocab().values()) + 1
    return Keys.of(n_a, sentencepiece.SentencePieceProcessor(model_proto=file_bytes(b_file)).get_piece_size())


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each document."""
    sc, aligned = docs.sparkSession.sparkContext, aligned_batches(docs, a_file, b_file)
    keys = _keys(a_file, b_file)
    counts = materialize(pair_counts(aligned, keys), "best-pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(HOT).toArrow().sort_by("pair")
    hot = sc.broadcast([top.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])

    def looked_up(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is hot, count, best) of each link; zeros where it isn't hot."""
        pair, n, best = hot.value
        if not len(pair):
            return np.zeros(len(links), bool), np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
        at = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
        known = pair[at] == links
        return known, np.where(known, n[at], 0), (known & best[at]).astype(np.int64)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                run, n_pieces, n_links, links = _unpacked(batch, row, keys, "run", "n_pieces", "n_links", "links")
                _, n, best = looked_up(links)
                sums = [_totals(_totals(x, n_links)[run], n_pieces) for x in (np.ones(len(links), np.int64), best, n)]
                own = [batch.column(c)[row].values for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
                index = np.arange(len(n_pieces), dtype=np.int32)
                columns = [index, own[0], own[1], own[2], own[3], sums[0], own[4], sums[1], sums[2]]
                arrays = [pa.array(c) if isinstance(c, np.ndarray) else c for c in [np.full(len(index), batch.column("batch")[row].as_py()), *columns]]
                yield pa.RecordBatch.from_arrays(arrays, names=["batch", *(f.split()[0] for f in DOCUMENT.split(", "))])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                run, n_pieces, n_links, links = _unpacked(batch, row, keys, "run", "n_pieces", "n_links", "links")
                rare = ~looked_up(links)[0]
                sizes = _totals(rare.astype(np.int64), n_links)
                document = np.repeat(np.repeat(np.arange(len(n_pieces)), n_pieces), sizes[run])
                pair = gathered(links[rare], sizes, run).astype(np.int64)
                order = np.lexsort((pair, document))
                document, pair = document[order], pair[order]
                first = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(pair)))
                columns = [np.full(len(first), batch.column("batch")[row].as_py()), document[first].astype(np.int32), pair[first], n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["batch", "i", "pair", "times"])
        give_back()

    rows = aligned.mapInArrow(by_document, f"batch long, {DOCUMENT}")
    rest = aligned.select("batch", "run", "n_pieces", "n_links", "links").mapInArrow(others, "batch long, i int, pair long, times long")
    times = F.col("times")
    rest = rest.join(counts.hint("merge"), "pair").groupBy("batch", "i").agg(F.sum(times * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), times).otherwise(0)).alias("more_best"))
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.join(rest, ["batch", "i"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more"), "groups_sha256")
