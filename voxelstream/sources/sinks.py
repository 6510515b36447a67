"""Writers: frames as partitioned Parquet with a metadata sidecar, and the shift log as CSV."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed4

#: Columns of the two shift logs.
SHIFT_LOG = ("position_index", "timepoint_index", "shift_z_um", "shift_y_um", "shift_x_um", "stage_x", "stage_y", "stage_z")


ARCHIVED_LOG = ("PositionID", "TimepointID", "ShiftZ", "ShiftY", "ShiftX", "StageZ", "StageY", "StageX")


def write_frames(frames: DataFrame, path: str, channels: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0), summary: dict | None = None) -> None:
    """Frames under acq/p/t/c folders, never over existing ones, and a JSON sidecar (path.metadata) with axes and scale."""
    frames.write.mode("errorifexists").partitionBy("acq", "p", "t", "c").option("compression", "zstd").parquet(path)
    transform = [{"type": "scale", "scale": [1.0, 1.0, *scale]}]
    axes = [{"name": a, "type": k} for a, k in (("t", "time"), ("c", "channel"), ("z", "space"), ("y", "space"), ("x", "space"))]
    sidecar = {"multiscales": [{"version": "0.5", "axes": axes, "datasets": [{"path": "0", "coordinateTransformations": transform}]}], "channels": channels, "summary": summary or {}}
    frames.sparkSession.createDataFrame([(json.dumps(sidecar),)], "value string").coalesce(1).write.text(f"{path}.metadata")


def shift_log(rows: DataFrame) -> DataFrame:
    """The log's columns: indices, and texts with four decimals (a null height is empty)."""
    return rows.select("position_index", "timepoint_index", *[fixed4(F.col(c)).alias(c) for c in SHIFT_LOG[2:]])


def write_shift_log(rows: DataFrame, path: str) -> None:
    """Append to the log. Its names are written once, in a file that sorts before the others."""
    names = rows.sparkSession.createDataFrame([SHIFT_LOG], ", ".join(f"`{c}` string" for c in SHIFT_LOG))
    names.coalesce(1).write.mode("ignore").csv(f"{path}/names=0")
    shift_log(rows).write.mode("append").csv(f"{path}/names=1")


def read_shift_log(spark: SparkSession, path: str) -> DataFrame:
    """What was logged; an empty height is null."""
    schema = ", ".join(f"{c} {'long' if c.endswith('_index') else 'double'}" for c in SHIFT_LOG)
    return spark.read.schema(schema).csv(f"{path}/names=1")


def archived_log(rows: DataFrame) -> DataFrame:
    """The log of the older tracker: its own names, and a row without shift at the first timepoint."""
    first = F.col("timepoint_index") == 0
    shifts = [F.when(first, 0.0).otherwise(F.col(f"shift_{a}_um")).alias(f"Shift{a.upper()}") for a in "zyx"]
    stage = [F.col(f"stage_{a}").alias(f"Stage{a.upper()}") for a in "zyx"]
    return rows.select(F.col("position_index").alias("PositionID"), F.col("timepoint_index").alias("TimepointID"), *shifts, *stage)


def write_archived_log(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file for each position, appended to or begun anew."""
    log = archived_log(rows)
    log.withColumn("fov", F.col("PositionID")).write.mode("overwrite" if overwrite else "append").partitionBy("fov").option("header", True).csv(path)


def first_free(taken: DataFrame, index: str) -> DataFrame:
    """One row: the smallest number from 1 that is not taken."""
    used = taken.select(F.col(index).cast("long").alias("i")).where("i >= 1").distinct()
    tried = used.select((F.col("i") + 1).alias("i")).unionByName(used.sparkSession.range(1, 2).toDF("i"))
    return tried.join(used, "i", "left_anti").agg(F.min("i").alias("first_free"))


def folder_name(name: Column, position: Column) -> Column:
    """Letters and digits of a name; 'p' and the index if none are left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z0-9]", ""), F.lit("")), F.concat(F.lit("p"), position.cast("string")))
