"""Decision tables from acquisition data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
NEAR_UM, FAR_UM = 1.0, 2000.0
SLOW, FAST = 2.0, 5.75
LASERS = {32: 488, 64: 561, 128: 639}


def stage_speed(moves: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """``distance``, ``speed`` and ``change``: the speed class of each move, and whether it must be set anew.

    Moves below NEAR_UM keep the speed, those below FAR_UM are slow, others fast; a speed set before is not set again.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    gone = F.sqrt(F.pow(F.col(x) - F.lag(x).over(along), F.lit(2.0)) + F.pow(F.col(y) - F.lag(y).over(along), F.lit(2.0)))
    wanted = F.when(F.col("distance") < NEAR_UM, None).when(F.col("distance") < FAR_UM, SLOW).when(F.col("distance").isNotNull(), FAST)
    before = F.last("speed", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    moved = moves.withColumn("distance", gone).withColumn("speed", wanted)
    return moved.withColumn("change", F.col("speed").isNotNull() & ~F.col("speed").eqNullSafe(before))


def light_sheet_rate(exposure: Column, readout: Column) -> Column:
    return F.lit(1000.0) / (exposure + readout + 0.05)


def label_free_rate(exposure: Column, fps: Column) -> Column:
    return F.least(F.lit(1000.0) / (exposure + 1.5), F.floor(fps).cast("double"))


def acquisition_time(stacks: DataFrame, keys: list[str], n_z: Column, rate: Column, change_s: float) -> DataFrame:
    """Seconds for the channels of an acquisition: slices over rate, and a change between channels."""
    return stacks.groupBy(*keys).agg(scan_seconds(n_z, rate, change_s).alias("seconds"))


def scan_seconds(n_z: Column, rate: Column, change_s: float) -> Column:
    """The aggregate of ``acquisition_time``, to be taken with others in one pass."""
    return F.sum(n_z / rate) + change_s * (F.count("*") - 1)


def refocus(stacks: DataFrame, keys: list[str], focus: str, peak: str, n_range: int) -> DataFrame:
    """``focus_index`` (median of the valid ones, truncated), or which way to scan further if none is valid."""
    last = n_range - 1
    out = stacks.groupBy(*keys).agg(
        F.floor(F.median(focus)).cast("int").alias("focus_index"),
        F.bool_and(F.col(peak) < 0.2 * last).alias("_left"),
        F.bool_and(F.col(peak) > 0.8 * last).alias("_right"),
    )
    none = F.col("focus_index").isNull()
    return out.select(*keys, "focus_index", (none & F.col("_left")).alias("scan_left"), (none & F.col("_right")).alias("scan_right"))


def changes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``changed``: the value differs from the one before; the first one counts as a change."""
    return rows.withColumn("changed", ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*keys).orderBy(order))))


def same_set(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: how many values are on one side only."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").agg(F.count("*").alias("only_left")).join(b.join(a, column, "left_anti").agg(F.count("*").alias("only_right")))


def laser(state: Column) -> Column:
    """Wavelength of the laser that a TTL state selects; null for other states."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LASERS.items() for x in pair]), state)


def z_steps(rows: DataFrame, keys: list[str], order: str, z: str) -> DataFrame:
    """``step``: the first height, then the differences between heights."""
    return rows.withColumn("step", F.col(z) - F.lag(z, 1, 0.0).over(Window.partitionBy(*keys).orderBy(order)))


def first_contrast(frames: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, low, high of the first frame of each key; nothing for a constant one. A frame is a value of ``order``."""
    place = F.struct(*order)
    first = frames.groupBy(*keys).agg(F.min(place).alias("_first"))
    own = frames.withColumn("_place", place).join(first, keys).where("_place = _first")
    return own.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high")


def compensation(points: DataFrame, keys: list[str], direction: str, sweep: str, x: str, y: str) -> DataFrame:
    """keys, factor: mean slope of the forward sweeps over that of the backward ones (direction 1 and -1)."""
    slopes = points.groupBy(*keys, direction, sweep).agg(F.regr_slope(y, x).alias("s"))
    mean = lambda d: F.avg(F.when(F.col(direction) == d, F.col("s")))
    return slopes.groupBy(*keys).agg(F.try_divide(mean(1), mean(-1)).alias("factor"))


def sequenced_too_long(n_z: int, n_channels: int, most: int = 1200) -> bool:
    """Whether a hardware sequence has more events than the devices can hold."""
    return n_z * n_channels > most


def valid_range(rows: DataFrame, position: str, start: str, end: str, step: float, low: float = 0.0, high: float = 30.0, least: int = 3) -> DataFrame:
    """``offsets``: relative positions of a focus scan whose absolute ones lie within the limits; null if fewer than ``least``."""
    n = F.ceil((F.col(end) + step - F.col(start)) / step).cast("int")
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(start) + i * F.lit(step))
    inside = F.filter(every, lambda o: (o + F.col(position) >= low) & (o + F.col(position) <= high))
    return rows.withColumn("offsets", F.when(F.size(inside) >= least, inside))


def illumination_complete(illumination: DataFrame, wells: DataFrame, least_ms: float) -> DataFrame:
    """One row: whether all exposures are above the least one, and how many wells are on one side only."""
    above = illumination.agg(F.coalesce(F.bool_and(F.col("exposure_time_ms") > least_ms), F.lit(True)).alias("exposures_ok"))
    return above.join(same_set(illumination, wells, "well_id"))
