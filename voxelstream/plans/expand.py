"""Declarative acquisition plans as event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def z_count(start: Column, end: Column, step: Column) -> Column:
    """Slices from start to end inclusive; the last may lie beyond the end."""
    return F.ceil((end + step - start) / step).cast("long")


def expand(spark: SparkSession, sizes: dict[str, int], order: str = "tpcz") -> DataFrame:
    """Index columns of every event and ``seq``, its place in the nested loops of ``order``.

    The place is arithmetic on one distributed range, so no global sort or join is needed.
    """
    total = 1
    for axis in order:
        total *= sizes[axis]
    events, stride, columns = spark.range(total).withColumnRenamed("id", "seq"), total, {}
    for axis in order:
        stride //= sizes[axis]
        columns[axis] = F.pmod(F.floor(F.col("seq") / F.lit(stride)).cast("long"), F.lit(sizes[axis]))
    return events.withColumns(columns)


def z_slices(plans: DataFrame, start: str, end: str, step: str) -> DataFrame:
    """A row for each slice of each plan, with ``z`` and ``z_um``; positions are multiples, never running sums."""
    n = z_count(F.col(start), F.col(end), F.col(step))
    rows = plans.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("z_um", F.col(start) + F.col("z") * F.col(step))


def well_ids(labels: DataFrame, label: str) -> DataFrame:
    """``well``: what stands before '-Site_', else before '-Pos', else '0'; one bad label demotes the whole list."""
    parts = lambda mark: F.split(F.col(label), mark)
    every = labels.agg(
        F.bool_and(F.size(parts("-Site_")) == 2).alias("sites"), F.bool_and(F.size(parts("-Pos")) == 2).alias("poses")
    )
    well = F.when(F.col("sites"), parts("-Site_")[0]).when(F.col("poses"), parts("-Pos")[0]).otherwise(F.lit("0"))
    return labels.join(every).withColumn("well", well).drop("sites", "poses")


def failing(events: DataFrame, entries: DataFrame, axes: list[str]) -> DataFrame:
    """Events that match all given indices of some entry; a null index matches any. Spark broadcasts entries if they are few."""
    match = F.lit(True)
    for axis in axes:
        match = match & (entries[axis].isNull() | (entries[axis] == events[axis]))
    return events.join(entries, match, "left_semi")


def upsert_property(properties: Column, device: str, name: str, value: Column) -> Column:
    """A property list with (device, name) set: in place if there, else appended. Values are texts."""
    new = F.struct(F.lit(device).alias("device"), F.lit(name).alias("property"), value.cast("string").alias("value"))
    is_it = lambda p: (p["device"] == device) & (p["property"] == name)
    return F.when(F.exists(properties, is_it), F.transform(properties, lambda p: F.when(is_it(p), new).otherwise(p))).otherwise(F.concat(properties, F.array(new)))


def time_points(spark: SparkSession, interval_s: float, loops: int | None = None, duration_s: float | None = None) -> DataFrame:
    """(t, start_s): ``loops`` timepoints, or as many as begin within the duration."""
    if (loops is None) == (duration_s is None):
        raise ValueError("a time plan has loops or a duration")
    if loops is None:
        if interval_s <= 0:
            raise ValueError("a duration needs an interval above zero")
        loops = int(duration_s // interval_s) + 1
    return spark.range(loops).select(F.col("id").alias("t"), (F.col("id") * F.lit(float(interval_s))).alias("start_s"))


def time_plans(plans: DataFrame, interval_s: str, loops: str, duration_s: str) -> DataFrame:
    """Plans as rows -> a row for each timepoint, ``t`` and ``start_s``: the plan's loops, or as many as begin within its duration.

    A plan with neither or with both, or with a duration and no interval above zero, has no timepoints.
    """
    begun = F.when(F.col(interval_s) > 0, F.floor(F.col(duration_s) / F.nullif(F.col(interval_s), F.lit(0))) + 1)
    n = F.when(F.col(duration_s).isNull(), F.col(loops)).when(F.col(loops).isNull(), begun).cast("long")
    every = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")))
    return plans.withColumn("t", every).withColumn("start_s", F.col("t") * F.col(interval_s).cast("double"))


def well_grid(wells: DataFrame, grid_rows: int, grid_columns: int, spacing_um: tuple[float, float], fov_um: tuple[float, float], overlap: tuple[float, float] = (0.0, 0.0), corner_um: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Wells (row, column) -> a row for each field of view: well, g, x, y.

    Wells lie right of and below the first one; fields are numbered row by row and centred on their well. Overlap is
    in percent of a field, below zero for gaps.
    """
    fields = wells.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid_rows * grid_columns - 1).cast("long"))))
    step_x, step_y = (f * (1 - o / 100) for f, o in zip(fov_um, overlap, strict=True))
    across, down = F.pmod("g", F.lit(grid_columns)), F.floor(F.col("g") / F.lit(grid_columns))
    name = F.concat(F.chr(F.col("row") + 65), (F.col("column") + 1).cast("string"))
    x = F.col("column") * spacing_um[0] + corner_um[0] + (across - (grid_columns - 1) / 2) * step_x
    y = corner_um[1] - F.col("row") * spacing_um[1] - (down - (grid_rows - 1) / 2) * step_y
    return fields.withColumns({"well": name, "x": x, "y": y})


def well_defaults(wells: DataFrame, well: str, channels: list[str], exposures: list[float], powers: list[float | None]) -> DataFrame:
    """(well, channel, exposure, power): the defaults of every channel for each distinct well."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(e).cast("double").alias("exposure"), F.lit(p).cast("double").alias("power")) for c, e, p in zip(channels, exposures, powers, strict=True)])
    return wells.select(F.col(well).alias("well")).distinct().select("well", F.inline(rows))


def without_focus_moves(properties: Column, stage: str, enabled: bool) -> Column:
    """Properties to set: positions of the autofocus stage are left out while autofocus holds it."""
    if not enabled:
        return properties
    return F.filter(properties, lambda p: ~((p["property"] == "Position") & (p["device"] == stage)))


#: Properties and functions whose log records tell nothing.
QUIET_PROPERTIES = ("PFS Status", "PFS in Range", "FocusMaintenance")
QUIET_FUNCTIONS = ("_property_change_emission_ensured",)


def worth_logging(rows: DataFrame, name: str, quiet: tuple[str, ...] = QUIET_PROPERTIES) -> DataFrame:
    """Records but for those of quiet properties or functions; records without a name stay."""
    return rows.where(F.col(name).isNull() | ~F.col(name).isin(*quiet))


def store_from_plan(positions: DataFrame, z_device: str | None = None) -> DataFrame:
    """(p, x, y, z) to begin with: x and y of zero where unset, z from the device's Position property if there is one."""
    z = F.col("z")
    if z_device is not None:
        held = F.filter("properties", lambda q: (q["device"] == z_device) & (q["property"] == "Position"))
        z = F.coalesce(F.try_element_at(held, F.lit(1))["value"].cast("double"), z)
    return positions.select("p", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), z.alias("z"))
