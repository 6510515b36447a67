"""Per-volume statistics on long voxel rows: one row per voxel, any key columns, a value column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def _bounds(voxels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Voxels with the least and greatest value of their volume; the small bounds are joined back by key."""
    bounds = voxels.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return voxels.join(bounds, keys)


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.when(lo == hi, F.lit(0)).otherwise(F.least(F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))).cast("long")


def histogram(voxels: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """keys, bin, n, lo, hi for bins that hold voxels: equal bins from least to greatest, the last one closed."""
    bounded = _bounds(voxels, keys, value)
    return bounded.groupBy(*keys, "lo", "hi", _bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def percentile_by_histogram(voxels: DataFrame, keys: list[str], value: str, percent: float, bins: int = 256) -> DataFrame:
    """keys, percentile: the upper edge of the first bin whose cumulative share reaches ``percent``; the value if constant."""
    return percentile_of_histogram(histogram(voxels, keys, value, bins), keys, percent, bins)


def percentile_of_histogram(h: DataFrame, keys: list[str], percent: float, bins: int = 256) -> DataFrame:
    """``percentile_by_histogram`` of a ``histogram``."""
    up_to = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = h.withColumn("share", F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy(*keys)))
    found = shares.where(F.col("share") >= percent / 100).groupBy(*keys, "lo", "hi").agg(F.min("bin").alias("bin"))
    edge = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins)
    return found.select(*keys, edge.alias("percentile"))


def exact_percentiles(voxels: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """keys and a column for each share: exact percentiles, interpolated between neighbouring ranks; nulls don't count.

    Voxels are counted by value first, where they are, so a value that most of them share is one row. A histogram of
    these counts tells which bins hold the wanted ranks; only the values of such bins are sorted, and their ranks are
    running sums of counts.
    """
    counted = voxels.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = _bounds(counted, keys, "_v").withColumn("bin", _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins)).select(*keys, "bin", "_v", "_c")
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "bin").agg(F.sum("_c").alias("n"))
    sums = sums.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("_n", F.sum("n").over(Window.partitionBy(*keys)))
    places = F.array(*[F.lit(s) * (F.col("_n") - 1) for s in shares.values()])
    ranks = F.flatten(F.transform(places, lambda r: F.array(F.floor(r), F.ceil(r))))
    wanted = sums.where(F.exists(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("n")))).select(*keys, "bin", "_below", "_n")
    up_to = F.sum("_c").over(Window.partitionBy(*keys, "bin").orderBy("_v")) + F.col("_below")
    inside = placed.join(wanted, [*keys, "bin"]).withColumn("_end", up_to)
    out = []
    for name, s in shares.items():
        place = F.lit(s) * (F.col("_n") - 1)
        held = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))
        low, high = (F.max(F.when(held(f(place)), F.col("_v"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return inside.groupBy(*keys).agg(*out)


def otsu_thresholds(voxels: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """keys, a, b, low, high: the two thresholds of three-class Otsu.

    Candidate pairs number bins * bins / 2 for a volume, whatever its size; the first best pair wins. A constant
    volume has both thresholds at its value and no a, b.
    """
    h = histogram(voxels, keys, value, bins)
    bounds = h.select(*keys, "lo", "hi").distinct()
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(h.select(*keys, "bin", "n"), [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    every, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    center = F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / (bins - 1))
    share = full.withColumn("p", F.col("n") / F.sum("n").over(every)).withColumn("pc", F.col("p") * center)
    sums = share.select(*keys, "lo", "hi", "bin", F.sum("p").over(up_to).alias("w"), F.sum("pc").over(up_to).alias("m"), F.sum("pc").over(every).alias("mu"))
    left = sums.where("lo < hi").select(*keys, "lo", "hi", "mu", F.col("bin").alias("a"), F.col("w").alias("w_a"), F.col("m").alias("m_a"))
    right = sums.select(*keys, F.col("bin").alias("b"), F.col("w").alias("w_b"), F.col("m").alias("m_b")).where(F.col("b") <= bins - 2)
    pairs = left.join(right, keys).where("a < b").withColumns({"w1": F.col("w_b") - F.col("w_a"), "w2": F.lit(1.0) - F.col("w_b")})
    pairs = pairs.where((F.col("w_a") > TINY) & (F.col("w1") > TINY) & (F.col("w2") > TINY))
    part = lambda w, m: w * F.pow(m / w - F.col("mu"), F.lit(2.0))
    between = part(F.col("w_a"), F.col("m_a")) + part(F.col("w1"), F.col("m_b") - F.col("m_a")) + part(F.col("w2"), F.col("mu") - F.col("m_b"))
    first = F.struct(F.round(between, 9).alias("sigma"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    best = pairs.groupBy(*keys).agg(F.max(first).alias("_best")).select(*keys, (-F.col("_best.a")).alias("a"), (-F.col("_best.b")).alias("b"))
    at = lambda k: F.coalesce(F.col("lo") + (F.col(k) + 1) * ((F.col("hi") - F.col("lo")) / (bins - 1)), F.col("lo"))
    return bounds.join(best.select(*keys, "a", "b"), keys, "left").select(*keys, "a", "b", at("a").alias("low"), at("b").alias("high"))


def mask_centroid(voxels: DataFrame, keys: list[str], mask: Column, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """keys, c_<axis>: mean place of the masked voxels; the origin for none."""
    return voxels.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(mask, F.col(a))), F.lit(0.0)).alias(f"c_{a}") for a in axes])


def intensity_centroid(voxels: DataFrame, keys: list[str], value: Column, background: Column | None = None, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """keys, c_<axis>: mean place weighted by what is above the background; the geometric centre if nothing is."""
    weight = F.greatest(value - (background if background is not None else F.lit(0.0)), F.lit(0.0))
    sums = voxels.withColumn("_w", weight).groupBy(*keys).agg(
        F.sum("_w").alias("_total"), *[F.sum(F.col("_w") * F.col(a)).alias(f"_{a}") for a in axes], *[F.max(a).alias(f"_last_{a}") for a in axes]
    )
    at = lambda a: F.when(F.col("_total") > 0, F.col(f"_{a}") / F.nullif(F.col("_total"), F.lit(0.0))).otherwise(F.col(f"_last_{a}") / 2)
    return sums.select(*keys, *[at(a).alias(f"c_{a}") for a in axes], *[(at(a) - F.col(f"_last_{a}") / 2).alias(f"d_{a}") for a in axes])


def projections(voxels: DataFrame, keys: list[str], value: str, threshold: float, over: str = "z", axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Maximum and any-above-threshold projection along one axis."""
    return voxels.groupBy(*keys, *axes).agg(F.max(value).alias("v_max"), F.bool_or(F.col(value) > threshold).alias("v_any"))


def flatfield(voxels: DataFrame, volume: list[str], pixel: list[str], value: str) -> DataFrame:
    """Value over its pixel's median along z, times the mean of those medians; null where the median is zero."""
    medians = voxels.groupBy(*volume, *pixel).agg(F.median(value).alias("med"))
    means = medians.groupBy(*volume).agg(F.avg("med").alias("mean_med"))
    flat = F.try_divide(F.col(value), F.col("med")) * F.col("mean_med")
    return voxels.join(medians, [*volume, *pixel]).join(means, volume).withColumn("flat", flat).drop("med", "mean_med")


def normalize(voxels: DataFrame, keys: list[str], value: str, how: str, clip: float = 1.5, eps: float = 1e-8) -> DataFrame:
    """``norm``: 'minmax', 'symmetric' (-1..1), 'zscore' (sample deviation) or 'iqr' (z-score clipped by quartiles)."""
    v = F.col(value)
    if how in ("minmax", "symmetric"):
        stats = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        unit = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
        return voxels.join(stats, keys).withColumn("norm", unit if how == "minmax" else unit * 2 - 1).drop("_lo", "_hi")
    if how == "zscore":
        stats = voxels.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
        return voxels.join(stats, keys).withColumn("norm", (v - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std")
    if how == "iqr":
        quartiles = exact_percentiles(voxels, keys, value, {"_q1": 0.25, "_q3": 0.75})
        spread = F.col("_q3") - F.col("_q1")
        clipped = voxels.join(quartiles, keys).withColumn("_c", F.greatest(F.col("_q1") - clip * spread, F.least(F.col("_q3") + clip * spread, v))).drop("_q1", "_q3")
        return normalize(clipped, keys, "_c", "zscore", eps=eps).drop("_c")
    raise ValueError(f"unknown normalization {how!r}")


def std_peak(voxels: DataFrame, keys: list[str], row: str, value: str, width: int = 5) -> DataFrame:
    """keys, peak: the row where the moving average (whole windows only) of row deviations is greatest."""
    rows = voxels.groupBy(*keys, row).agg(F.stddev_pop(value).alias("s"))
    ahead = Window.partitionBy(*keys).orderBy(row).rowsBetween(0, width - 1)
    smooth = rows.withColumn("a", F.round(F.avg("s").over(ahead), 9)).withColumn("n", F.count("*").over(ahead)).where(F.col("n") == width)
    first = Window.partitionBy(*keys).orderBy(F.desc("a"), row)
    return smooth.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, F.col(row).alias("peak"))


def slope(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept of the least-squares line."""
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
