"""Token ids of a corpus in binary shards, in ascending doc_id order.

Documents are dealt into ranges of doc_id; each task encodes its range in order and packs whole documents into
Re-Pair shards (see ``repair``), which Spark's writer stores as rows of (part, shard, before, n_ids, payload).
``part`` counts the ranges in order and ``before`` the ids of earlier shards of the range, so the place of any
document in the whole stream follows from one small sum per range.

Defined results: null and empty texts have only the end id; null doc_ids come first; repeated rows are stored
each, next to each other (ordered by text); an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, shared_path, slices, text_or_empty
from .repair import Shard, pack
from .tokenizing import by_bytes, library_tokenizer

SHARD_IDS = 1 << 19  # ids after which a shard is closed; a document is never cut
ENCODE_BYTES = 8 << 20  # bytes of text whose distinct matches are encoded together; more of them repeat in more text
END = 0
SCHEMA = "part int, shard int, before long, n_ids long, payload binary"


def write_store(docs: DataFrame, tokenizer_file: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode every document and write the shards to ``path``."""
    content = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(content.value)
        base, end = tokenizer.size, np.array([END], np.uint32)
        part, shard, before, doc_ids, held = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            n = sum(map(len, held))
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([pack(doc_ids, held, base)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "before", "n_ids", "payload"])

        size = 0
        for batch in by_bytes(batches, size=ENCODE_BYTES):
            flat, sizes = tokenizer.encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                doc_ids.append(doc_id)
                held.append(np.append(ids, end))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield close()
                    shard, before, size = shard + 1, before + size, 0
                    doc_ids.clear()
                    held.clear()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, decoded from the shards."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each range
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part] = total
        total += n
    shared = spark.sparkContext.broadcast(offsets)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard = Shard.unpack(batch.column("payload")[0].as_py())
            ids = shard.all_ids().astype("<u4")
            ends = np.cumsum(shard.sizes)
            starts = ends - shard.sizes
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            first = shared.value[batch.column("part")[0].as_py()] + batch.column("before")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "payload").mapInArrow(decode, out)


def token_store(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and report every document from them."""
    path = path or shared_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer_file, path)
    return read_store(docs.sparkSession, path)
