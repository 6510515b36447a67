"""SimHash near-duplicates: fingerprints of three-word shingles linked within two bits.

Copies share a fingerprint, so they meet once: distinct fingerprints go through the vantage-point trees, the
components are found among those, and every document takes its component from its fingerprint.

Defined results: null, empty and word-less texts have fingerprint zero; texts below three words are one shingle;
repeated rows each get their row and stay or go together; a null doc_id takes part and is never the smallest (its
component is null if no linked row has an id); an empty table gives an empty result; further columns, whatever their
names, are carried by the stage and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8, without
from .components import connected_components
from .vantage import hamming_links

SHINGLE = 3
SEED = 42
REACH = 2
HASHES = 65_536  # shingle hashes held at a time

#: How many of a byte's eight bits are set at each place.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Unsigned hashes of the shingles, in blocks. ``lower`` and ``split`` of bytes know ASCII only, as they should."""
    words = text.lower().split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    for at in range(0, len(starts), HASHES):
        a, b = starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()
        yield np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))


def majority(blocks: Iterator[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        places = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
        seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ _BITS).ravel()
        n += len(hashes)
    return int(np.bitwise_or.reduce(np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64), initial=np.uint64(0)))


def fingerprint(text: bytes) -> int:
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, fp): a row for each document, written once; ``hash`` tells texts of one doc_id apart."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(fp.view(np.int64))], names=["doc_id", "hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("hash"), utf8().alias("text"))
    return materialize(rows.mapInArrow(compute, "doc_id long, hash long, fp long"), "fingerprints")


def near_duplicates(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``fingerprints`` with component_id."""
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(hamming_links(distinct.select("fp"), reach))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp")


def simhash(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint, component_id for each document."""
    return near_duplicates(fingerprints(docs), reach).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with its own columns."""
    gone = near_duplicates(fingerprints(docs), reach).where("doc_id <> component_id").select("doc_id", "hash").distinct()
    return without(docs, materialize(gone, "near-copies"))
