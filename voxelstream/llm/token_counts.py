"""Token counts through a digest cache.

Contents are keyed by the SHA-256 of their normalised text (null becomes empty; byte-level tokenizers keep every
other byte, so nothing more may be folded) and by the SHA-256 of the tokenizer file, which also names the cache's
folders. Digests alone are compared with the cache; only of distinct contents that it lacks one text each is fetched and
encoded, and their counts are appended to it, so with a filled cache no text is moved. Every document then reads its
count by digest. Any tables may share a cache. Counts of digests that a large share of the rows has are broadcast (at most HEAVY of
``exact_dedup``), so that no hot digest is shuffled.

Defined results: null and empty texts have zero tokens; repeated rows each get their row; a null doc_id stays
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, materialize, shared_path, text_or_empty
from .exact_dedup import frequent
from .tokenizing import by_bytes, library_tokenizer

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
LIMIT = 512


def tokenizer_version(tokenizer_file: str) -> str:
    return hashlib.sha256(file_bytes(tokenizer_file)).hexdigest()


def open_cache(spark, path: str) -> DataFrame:
    """The stored counts at ``path``; a folder without any yet is made an empty cache."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("ignore").partitionBy("version").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _counter(kind: str, content: bytes):
    """Counts for an array of texts, as the tokenizer's own library gives them."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in model.encode(texts.to_pylist(), num_threads=1)]
    encode = library_tokenizer(content).encode
    return lambda texts: encode(texts)[1]


def encode_misses(misses: DataFrame, tokenizer_file: str, version: str) -> DataFrame:
    """(digest, text) -> (digest, version, n_tokens)."""
    content = misses.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_file))
    kind = tokenizer_file.rpartition(".")[2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in by_bytes(batches):
            counter = counter or _counter(kind, content.value)
            n = counter(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["digest", "version", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(count, CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_file: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; appends what was missing to the cache."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_file)
    cache_path = cache_path or shared_path(spark, "token-counts")
    stored = open_cache(spark, cache_path).where(F.col("version") == version)
    text = text_or_empty()
    keys = ["digest", "no_id", "id"]
    named = [F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    rows = materialize(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), *named), "digests")
    # Digests alone tell what is missing; then one row of each brings its text, met by its id, so that no copies do.
    wanted = rows.groupBy("digest").agg(F.min(F.struct("no_id", "id")).alias("one")).join(stored.select("digest"), "digest", "left_anti")
    wanted = materialize(wanted.select("digest", "one.*"), "missing-digests")
    misses = docs.select(text.alias("text"), *named).join(wanted, keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"))
    encode_misses(misses, tokenizer_file, version).write.mode("append").partitionBy("version").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = rows.select("doc_id", "n_bytes", "digest")
    hot = materialize(counts.join(F.broadcast(frequent(rows)), "digest"), "hot-counts")
    found = rows.join(F.broadcast(hot), "digest", "left")
    rest = found.where("n_tokens is null").drop("n_tokens").join(counts.hint("merge"), "digest")
    every = found.where("n_tokens is not null").unionByName(rest)
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
