"""Helpers shared by the training-data operators: tables, shared storage, batching."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import give_back, slices  # noqa: F401

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Only a local session may go without."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelstream-shared-"))
        configured = sc.getCheckpointDir()
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new path in the shared folder, which goes with the session unless it is ``kept``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not kept:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back with the same schema."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, out of the way of other names; ``own.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id (which may be null) and hash of the text are in ``gone``."""
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    keyed = docs.select(own(docs), *keys, F.xxhash64(utf8()).alias("hash"))
    return keyed.join(gone.select(*keys, "hash"), ["id", "no_id", "hash"], "left_anti").select("own.*")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return text_or_empty(column).cast("binary")


def file_bytes(path: str) -> bytes:
    """A tokenizer file, read on the driver; callers broadcast it (a few MB)."""
    with open(os.fspath(path), "rb") as f:
        return f.read()
