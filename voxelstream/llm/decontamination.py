"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Words are ordered by how many documents hold them, and the rarest word of a window is its necessary prefix: for exact
containment (threshold 1) one word is enough, so a document meets a window by joining on it. The word's place in the
window bounds where the window may lie in the document (position) and whether it fits there (length); what lies there
is then compared word by word.

Benchmark and documents are both tables that Spark joins. Two filters of a fixed size, made from all benchmark words
and from all prefix words, keep other document words out of the shuffle; a large benchmark fills them and lets more
words pass, but no match is lost.

Defined results: null or word-less texts have no words, windows or hits; items of fewer than ten words are one
window; equal items are all counted; items with a null id are ignored; repeated rows each get their row; a null
doc_id stays null; empty tables give empty results or no hits; further columns, whatever their names, are carried by
the stage and ignored by the report.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8, without

WINDOW = 10
SLOTS = 1 << 24  # bits of a word filter

#: Bytes of words keep their place, A-Z in lower case; every other ASCII byte separates.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WordFilter:
    """Whether a word may be one of the words the filter was made from: a bit for each slot of their hashes."""

    def __init__(self, bits: np.ndarray):
        self._bits = bits

    @classmethod
    def of(cls, words: DataFrame) -> WordFilter:
        """Of a column ``word``; at most SLOTS / 64 rows reach the driver."""
        slot = F.col("slot")
        slots = words.select(F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct()
        lines = slots.groupBy(F.shiftright(slot, 6).cast("int").alias("line")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        bits = np.zeros(SLOTS // 64, np.uint64)
        for line, some in lines.collect():
            bits[line] = some % 2**64
        return cls(bits)

    def passes(self, words: list[bytes]) -> np.ndarray:
        slots = np.fromiter(map(crc32, words), np.int64, len(words)) & (64 * len(self._bits) - 1)
        return (self._bits.view(np.uint8)[slots >> 3] >> (slots & 7) & 1).astype(bool)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(gram, size, item): each distinct window of each item, its words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(b" ".join(w).decode(), len(w), item) for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in dict.fromkeys(windows_of(words_of(text)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["gram", "size", "item"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), utf8().alias("text"))
    return materialize(items.mapInArrow(cut, "gram string, size int, item string").distinct(), "benchmark-windows")


def document_frequencies(docs: DataFrame, words: WordFilter) -> DataFrame:
    """(word, n): in how many documents each word that passes occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = list(set(words_of(text)))
                seen.update(compress(found, shared.value.passes(found).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = docs.select(utf8().alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, at, gram, size): the rarest word of each distinct window whose words all occur in documents."""
    grams = windows.select("gram", "size").distinct()
    words = materialize(grams.select("gram", "size", F.posexplode(F.split("gram", " ")).alias("at", "word")), "window-words")
    frequency = document_frequencies(docs, WordFilter.of(words))
    counted = words.join(frequency, "word").groupBy("gram", "size").agg(F.count("*").alias("there"), F.min(F.struct("n", "word", "at")).alias("rarest"))
    return materialize(counted.where("there = size").select("rarest.word", "rarest.at", "gram", "size"), "prefixes")


SPOTS = "doc_id long, hash long, n_words long, spots array<struct<word:string,pos:int,before:int,context:string>>"


def spots(docs: DataFrame, words: WordFilter) -> DataFrame:
    """A row for each document, written once, with the places of prefix words and the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    spot = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, found = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                n.append(len(words))
                places = np.flatnonzero(shared.value.passes(words)).tolist()
                found.append([{"word": words[i].decode(), "pos": i, "before": min(i, WINDOW - 1), "context": b" ".join(words[max(0, i - WINDOW + 1) : i + WINDOW]).decode()} for i in places])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(found, spot)], names=["doc_id", "hash", "n_words", "spots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("hash"), utf8().alias("text"))
    return materialize(rows.mapInArrow(find, SPOTS), "spots")


def hits(rows: DataFrame, rarest: DataFrame) -> DataFrame:
    """(doc_id, hash, start, size, gram): where windows lie in documents. Common words are left to AQE's skew join."""
    met = rows.select("doc_id", "hash", F.inline("spots")).join(rarest, "word")
    met = met.where("at <= before").withColumn("around", F.split("context", " ")).where(F.size("around") - (F.col("before") - F.col("at")) >= F.col("size"))
    # The conditions may be evaluated in any order, so the slice must be valid for rows that fail the others.
    there = F.array_join(F.slice("around", F.greatest(F.col("before") - F.col("at") + 1, F.lit(1)), F.col("size")), " ") == F.col("gram")
    return met.where(there).select("doc_id", "hash", (F.col("pos") - F.col("at")).alias("start"), "size", "gram").distinct()


#: Words inside sorted runs that may overlap.
_N_HIT = "aggregate(runs, struct(0L as n, 0 as upto), (s, r) -> struct(s.n + greatest(0, r.b - greatest(s.upto, r.a)) as n, greatest(s.upto, r.b) as upto), s -> s.n)"


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    windows = benchmark_windows(benchmark)
    rarest = prefixes(windows, docs)
    rows = spots(docs, WordFilter.of(rarest.select("word")))
    return windows, rows, materialize(hits(rows, rarest), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids for each document."""
    windows, rows, found = _found(docs, benchmark)
    keys = ["doc_id", "hash"]
    runs = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))).alias("runs"))
    items = found.select(*keys, "gram").distinct().join(windows, "gram").groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = runs.alias("r").join(items.alias("i"), F.expr("r.doc_id <=> i.doc_id and r.hash = i.hash")).select("r.doc_id", "r.hash", "runs", "items")
    every = rows.select("doc_id", "hash", "n_words").alias("d").join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.hash = h.hash"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return every.select(
        "d.doc_id",
        "n_words",
        F.coalesce(F.expr(_N_HIT), F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("runs").isNotNull().alias("contaminated"),
        items.alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    _, _, found = _found(docs, benchmark)
    return without(docs, materialize(found.select("doc_id", "hash").distinct(), "contaminated"))
