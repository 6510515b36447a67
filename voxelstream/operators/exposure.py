"""Exposure decisions: 1 over-exposed, -1 under-exposed, 0 nominal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .stats import exact_percentiles

HOT_PERCENTILE = 0.9999


def limits(dtype_max: float, max_percent: float, min_percent: float) -> tuple[float, float]:
    """Greatest and least intensity wanted, from shares of the type's range."""
    return dtype_max * (1 - max_percent / 100.0), dtype_max * min_percent / 100.0


def by_mean(voxels: DataFrame, keys: list[str], value: str, dtype_max: float, max_percent: float, min_percent: float) -> DataFrame:
    """Over if mean + deviation passes the maximum or the hot percentile is saturated; under if mean - deviation is low."""
    top, bottom = limits(dtype_max, max_percent, min_percent)
    stats = voxels.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).join(exact_percentiles(voxels, keys, value, {"hot": HOT_PERCENTILE}), keys, "left")
    flag = F.when((F.col("m") + F.col("s") > top) | (F.col("hot") >= dtype_max), 1).when(F.col("m") - F.col("s") < bottom, -1).otherwise(0)
    return stats.select(*keys, flag.alias("flag"))


def by_masked_mean(voxels: DataFrame, keys: list[str], value: str, dtype_max: float, max_percent: float, min_percent: float) -> DataFrame:
    """Hot pixels count as zero; the mean is compared with clamped low and high percentiles, under-exposure first."""
    top, bottom = limits(dtype_max, max_percent, min_percent)
    hot = exact_percentiles(voxels, keys, value, {"hot": HOT_PERCENTILE})
    masked = voxels.join(hot, keys).withColumn("v_masked", F.when(F.col(value) < F.col("hot"), F.col(value)).otherwise(0.0))
    ends = exact_percentiles(masked, keys, "v_masked", {"under": 0.001, "over": 0.95})
    stats = masked.groupBy(*keys, "hot").agg(F.avg("v_masked").alias("m")).join(ends, keys)
    stats = stats.withColumns({"under": F.greatest("under", F.lit(bottom)), "over": F.least("over", F.lit(top))})
    flag = F.when((F.col("m") < F.col("under")) | (F.col("m") < bottom), -1).when((F.col("m") > F.col("over")) | (F.col("hot") >= dtype_max), 1).otherwise(0)
    return stats.select(*keys, flag.alias("flag"))


def by_percentile(voxels: DataFrame, keys: list[str], value: str, dtype_max: float, max_percent: float, min_percent: float) -> DataFrame:
    """Over if the hot percentile passes the maximum, under if it is below the minimum."""
    top, bottom = limits(dtype_max, max_percent, min_percent)
    stats = exact_percentiles(voxels, keys, value, {"hot": HOT_PERCENTILE})
    flag = F.when((F.col("hot") > top) | (F.col("hot") >= dtype_max), 1).when(F.try_divide(F.lit(bottom), F.col("hot")) > 1, -1).otherwise(0)
    return stats.select(*keys, flag.alias("flag"))


def suggest(flag: Column, exposure: Column, power: Column, *, power_range: tuple[float, float], power_step: float, max_exposure: float, exposure_step: float) -> tuple[Column, Column]:
    """(power, exposure) to try next: the power steps while in its range, then the exposure; rounded half-even."""
    by_power = (power <= power_range[1]) & (power >= power_range[0])
    new_power = F.when(by_power, power - power_step * flag).otherwise(power)
    new_exposure = F.when(~by_power & (exposure <= max_exposure), exposure - exposure_step * flag).otherwise(exposure)
    return F.bround(new_power, 0), F.bround(new_exposure, 0)


def manual(wells: DataFrame, illumination: DataFrame, exposure: str, power: str) -> DataFrame:
    """Exposure and power by well; a well without a row keeps its own and has a null flag."""
    rows = illumination.select("well_id", F.col("exposure_time_ms").alias("_e"), F.col("laser_power_mW").alias("_p"), F.lit(0).alias("flag"))
    return wells.join(rows, "well_id", "left").withColumns({exposure: F.coalesce("_e", exposure), power: F.coalesce("_p", power)}).drop("_e", "_p")


def synthetic(voxels: DataFrame, keys: list[str], value: str, dtype_min: float, dtype_max: float) -> DataFrame:
    """``under``, ``over`` and ``nominal``: what is above the 1st percentile cut to the least value of the type, what is above the 90th raised to its greatest."""
    bounds = exact_percentiles(voxels, keys, value, {"_low": 0.01, "_high": 0.9})
    v = F.col(value)
    return voxels.join(bounds, keys).withColumns({"under": F.when(v > F.col("_low"), dtype_min).otherwise(v), "over": F.when(v > F.col("_high"), dtype_max).otherwise(v), "nominal": v}).drop("_low", "_high")


def adjust(settings: DataFrame, measure: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int, **limits) -> DataFrame:
    """Exposure and power stepped until ``measure`` (keys, flag) finds nothing wrong, for all keys side by side.

    ``state`` is 'found', 'failed' (no flag; the settings stay), 'limit' (exposure and power both at a bound) or
    'open' after the given number of rounds. ``limits`` are those of ``suggest`` with exposure_range and power_range.
    """
    bounds = {"exposure": limits.pop("exposure_range"), "power": limits["power_range"]}
    rows = settings.select(*keys, "exposure", "power", F.lit("open").alias("state"))
    for _ in range(rounds):
        flags = measure(rows.where("state = 'open'")).select(*keys, "flag")
        power, exposure = suggest(F.col("flag"), F.col("exposure"), F.col("power"), max_exposure=bounds["exposure"][1], **limits)
        moved = rows.join(flags, keys, "left").withColumns({"_power": power, "_exposure": exposure})
        at_limit = F.col("_exposure").isin(*bounds["exposure"]) & F.col("_power").isin(*bounds["power"])
        state = F.when(F.col("state") != "open", F.col("state")).when(F.col("flag").isNull(), "failed").when(F.col("flag") == 0, "found").when(at_limit, "limit").otherwise("open")
        step = (F.col("state") == "open") & (F.col("flag") != 0)
        moved = moved.select(*keys, F.when(step, F.col("_exposure")).otherwise(F.col("exposure")).alias("exposure"), F.when(step, F.col("_power")).otherwise(F.col("power")).alias("power"), state.alias("state"))
        path = shared_path(settings.sparkSession, "exposure")
        moved.write.parquet(path)
        rows = settings.sparkSession.read.schema(moved.schema).parquet(path)
        if rows.where("state = 'open'").isEmpty():
            break
    return rows
