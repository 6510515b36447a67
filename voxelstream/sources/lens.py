"""Views of the driver's tables as frames, voxels, stage moves and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_Z = 4  # slices of a stack in the frames view
SIDE = 4  # voxels along each axis of a volume in the voxels view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> p, c, seq, t, z, v: every N_Z events of a user and type are the slices of one timepoint."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("p"), F.col("event_type").alias("c"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    place = F.row_number().over(Window.partitionBy("p", "c").orderBy("seq")) - 1
    return rows.withColumn("t", F.floor(place / F.lit(N_Z)).cast("long")).withColumn("z", F.pmod(place, F.lit(N_Z)).cast("long"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> vec_id, p, t, voxels: the label is the position, vectors of a label follow in time."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("p"), F.col("embedding").cast("array<double>").alias("voxels"))
    return rows.withColumn("t", (F.row_number().over(Window.partitionBy("p").orderBy("vec_id")) - 1).cast("long"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volumes -> vec_id, p, t, z, y, x, v."""
    long = volumes(spark, sf_dir).select("vec_id", "p", "t", F.posexplode("voxels").alias("i", "v"))
    i = F.col("i").cast("long")
    return long.select("vec_id", "p", "t", F.floor(i / F.lit(SIDE * SIDE)).cast("long").alias("z"), F.pmod(F.floor(i / F.lit(SIDE)).cast("long"), F.lit(SIDE)).alias("y"), F.pmod(i, F.lit(SIDE)).alias("x"), "v")
