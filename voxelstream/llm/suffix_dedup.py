"""Removal of long repeated substrings through sharded suffix arrays.

Every window of SIZE bytes has a minimizer: the least hash of the K-byte strings in it, the leftmost of equals.
Neighbouring windows with one minimizer make a segment, and equal windows always have equal minimizers, so equal
windows meet when segments are dealt by minimizer. Minimizers met once hold no repeat and end there. Of segments
with equal bytes only the first goes on; the others lie wholly in repeats. Segments that differ but share a
minimizer are read from their documents, dealt into shards of whole minimizers, and sorted by a suffix array with
its permuted common prefixes (see ``suffix_array``); runs of suffixes that share SIZE bytes are repeats of their
earliest window. A minimizer with more than HOT different segments is split: its windows are dealt one by one, by
all their SIZE bytes instead of the K of the minimizer, and go through the same suffix arrays.

Segments count as equal if the 64-bit hashes of their minimizers and of their bytes are both equal; everything else
is compared byte by byte.

Defined results: null counts as empty; texts below SIZE bytes keep everything; a null doc_id comes last; rows
that repeat a doc_id are ordered by a hash of their text, and rows that also repeat the text are one document
(neither is earlier, both get the same result); an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, utf8
from .suffix_array import repeated_windows

SIZE = 100  # bytes of a repeated string
K = 24  # bytes of the strings that minimizers are chosen from
PIECE = 1 << 22  # windows of a long document taken at a time; below 2**24
HOT = 20_000  # different segments of one minimizer that still go to one shard
SHARD_BYTES = 2 << 20  # bytes of a suffix array, about
LAST = 2**63 - 1  # the place of a null doc_id

_ODD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def hashes(data: bytes) -> np.ndarray:
    """A hash of the K bytes at each place (K is three words of eight bytes)."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _ODD[0]
    words ^= words >> np.uint64(32)
    mixed = words[:-16] * _ODD[1]
    mixed ^= (words[8:-8] * _ODD[2]) >> np.uint64(7)
    mixed += words[16:] * _ODD[3]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(32)
    return mixed


def segments(data: bytes, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of all segments of ``data``, the joined bytes of pieces of the given lengths."""
    if len(data) < SIZE:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashed = hashes(data)
    low = np.uint64(0xFFFFFF)
    least = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    width, span = SIZE - K + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :]) if width > span else least
    place = (least & low).astype(np.int64)
    # Windows that leave their piece are none.
    ends = np.cumsum(pieces)
    start = np.arange(len(place))
    piece = np.repeat(np.arange(len(pieces)), pieces)[: len(place)]
    valid = start + SIZE <= ends[piece]
    begins = valid.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | (piece[1:] != piece[:-1])
    at = np.flatnonzero(begins)
    stops = np.minimum(np.append(at[1:], len(place)), ends[piece[at]] - SIZE + 1)
    return at, stops - at, hashed[place[at]]


SEGMENT = "m long, h long, doc long, tie long, at long, copy boolean"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> a row for each segment; ``at`` is 128 times its start plus its windows.

    Of equal segments met together all but the first are copies already. Their ``m`` becomes a number of their own,
    so that a passage of many documents is not sent to one task.
    """
    digest = xxhash.xxh3_64_intdigest

    def rows(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data, sizes = b"".join(p[3] for p in held), np.array([len(p[3]) for p in held])
        at, n, m = segments(data, sizes)
        view = memoryview(data)
        h = np.fromiter((digest(view[a : a + w + SIZE - 1]) for a, w in zip(at.tolist(), n.tolist(), strict=True)), np.uint64, len(at))
        ends = np.cumsum(sizes)
        piece = np.searchsorted(ends, at, "right")
        doc, tie, base = (np.array([p[k] for p in held], np.int64)[piece] for k in (0, 1, 2))
        start = base + at - (ends - sizes)[piece]
        order = np.lexsort((start, tie, doc, h, m))
        same = (m[order][1:] == m[order][:-1]) & (h[order][1:] == h[order][:-1])
        copy = np.zeros(len(m), bool)
        copy[order[1:]] = same
        apart = (doc.view(np.uint64) * _ODD[1]) ^ ((start.view(np.uint64) + tie.view(np.uint64)) * _ODD[0])
        columns = (np.where(copy, apart, m).view(np.int64), h.view(np.int64), doc, tie, start * 128 + n, copy)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["m", "h", "doc", "tie", "at", "copy"])

    held, size = [], 0
    for batch in slices(batches):
        for doc, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for base in range(0, max(1, len(text) - SIZE + 1), PIECE):
                piece = text[base : base + PIECE + SIZE - 1]
                if len(piece) < SIZE:
                    continue
                if size + len(piece) > PIECE + SIZE and held:
                    yield rows(held)
                    held, size = [], 0
                held.append((doc, tie, base, piece))
                size += len(piece)
    if held:
        yield rows(held)


CUT = "m long, doc long, tie long, start long, bytes binary"


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, packed text, wanted segments) -> their bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, 64):
        columns: list[list] = [[] for _ in range(5)]
        for doc, tie, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            for w in wanted:
                at, n = divmod(w["at"], 128)
                for column, value in zip(columns, (w["m"], doc, tie, at, text[at : at + n + SIZE - 1]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())], names=["m", "doc", "tie", "start", "bytes"])


WINDOW = f"{CUT}, copy boolean"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, packed text, wanted segments) -> each of their windows, with a hash of all its bytes for ``m``.

    Of equal windows met together all but the first are copies already, and carry no bytes.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, 256):
        places: dict[bytes, list[tuple[int, int, int]]] = {}
        for doc, tie, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            for w in wanted:
                at, n = divmod(w["at"], 128)
                for i in range(at, at + n):
                    places.setdefault(text[i : i + SIZE], []).append((doc, tie, i))
        rows = []
        for data, found in places.items():
            first, m = min(found), int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)
            rows += [(m, *place, b"" if place != first else data, place != first) for place in found]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["m", "doc", "tie", "start", "bytes", "copy"])


SPAN = "doc long, tie long, start long, stop long"


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CUT in the order of ``m`` -> spans of repeated bytes, by a suffix array over whole minimizers."""

    def shard(columns: list[list]) -> pa.RecordBatch:
        _, docs, ties, starts, data = columns
        docs, ties, starts = (np.array(x, np.int64) for x in (docs, ties, starts))
        # Owners in order of (doc, tie).
        order = np.lexsort((ties, docs))
        new = np.concatenate([[False], (docs[order][1:] != docs[order][:-1]) | (ties[order][1:] != ties[order][:-1])])
        owner = np.empty(len(docs), np.int64)
        owner[order] = np.cumsum(new)
        segment, offset = repeated_windows(data, owner, starts, SIZE)
        # Neighbouring windows of a segment make one span.
        begins = np.ones(len(segment), bool)
        begins[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(segment)) - 1
        s = segment[at]
        spans = (docs[s], ties[s], starts[s] + offset[at], starts[s] + offset[last] + SIZE) if len(at) else (np.zeros(0, np.int64),) * 4
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["doc", "tie", "start", "stop"])

    held: list[list] = [[] for _ in range(5)]
    size = 0
    for batch in slices(batches, 1024):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_BYTES and row[0] != held[0][-1]:
                yield shard(held)
                held, size = [[] for _ in range(5)], 0
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[4]) + 1
    if held[0]:
        yield shard(held)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, tie, text, doc_id), and whether some ``doc`` repeats: ``tie`` is 0 unless it does, and then a hash of the text.

    A null doc_id has the place of the greatest number, and another tie than rows that really have that.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), utf8().alias("text"), doc_id.alias("doc_id"))
    repeats = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    tie = F.xxhash64("text", F.col("doc_id").isNull()) if repeats else F.lit(0).cast("long")
    return rows.select("doc", tie.alias("tie"), "text", "doc_id"), repeats


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3).compress
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t) for t in batch.column(2).to_pylist()], pa.binary()), batch.column(3)], names=["doc", "tie", "packed", "doc_id"])


def repeated_spans(keyed: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc, tie, start, stop) spans of bytes that also occur earlier; they may overlap."""
    found = keyed.select("doc", "tie", "text").mapInArrow(_segment_rows, SEGMENT)
    same = Window.partitionBy("copy", "m").orderBy("h", "doc", "tie", "at")
    every = Window.partitionBy("copy", "m")
    marked = materialize(
        found.withColumn("before", F.lag("h").over(same))
        .withColumn("fresh", ~F.col("copy") & (F.col("before").isNull() | (F.col("before") != F.col("h"))))
        .withColumn("kinds", F.sum(F.col("fresh").cast("long")).over(every))
        .where("not fresh or kinds > 1")
        .select("doc", "tie", "at", "m", "fresh", (F.col("kinds") > HOT).alias("hot")),
        "repeated-segments",
    )
    start, windows = F.shiftright("at", 7), F.col("at").bitwiseAND(127)
    spans = marked.where("not fresh").select("doc", "tie", start.alias("start"), (start + windows + SIZE - 1).alias("stop"))

    def cut(wanted: DataFrame, rows, schema: str) -> DataFrame:
        asked = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "m")).alias("wanted"))
        return packed.join(asked, ["doc", "tie"]).select("doc", "tie", "packed", "wanted").mapInArrow(rows, schema)

    dealt = cut(marked.where("fresh and not hot"), _cut_rows, CUT)
    hot = marked.where("fresh and hot")
    if not hot.isEmpty():
        single = materialize(cut(hot, _window_rows, WINDOW), "hot-windows")
        spans = spans.unionByName(single.where("copy").select("doc", "tie", "start", (F.col("start") + SIZE).alias("stop")))
        dealt = dealt.unionByName(single.where("not copy").drop("copy"))
    spans = spans.unionByName(dealt.repartition("m").sortWithinPartitions("m").mapInArrow(_shard_rows, SPAN))
    return spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [tuple(r) for r in runs]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, 64):
        rows = []
        for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            runs = merged([(s["start"], s["stop"]) for s in spans or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((doc, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def _with_spans(docs: DataFrame) -> DataFrame:
    keyed, repeats = _keyed(docs)
    packed = materialize(keyed.mapInArrow(_packed_rows, "doc long, tie long, packed binary, doc_id long"), "packed-texts")
    once, once_packed = (x.dropDuplicates(["doc", "tie"]) if repeats else x for x in (keyed, packed))
    spans = repeated_spans(once, once_packed).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return packed.join(spans, ["doc", "tie"], "left").select("doc_id", "packed", "spans")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    return _with_spans(docs).mapInArrow(_kept_rows, RESULT)


def removed_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left, bytes that no longer make a character replaced."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 64):
            ids, texts = [], []
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, out, at = unpack(packed), [], 0
                for a, b in merged([(s["start"], s["stop"]) for s in spans or ()]):
                    out.append(text[at:a])
                    at = b
                ids.append(doc)
                texts.append(b"".join([*out, text[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_spans(docs).mapInArrow(left, "doc_id long, text string")
