"""Frames: replay by request, stack assembly, and readers of the small side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import wrapped

ILLUMINATION = {"well_id", "exposure_time_ms", "laser_power_mW"}
POSITIONS = "position_ind int, well_id string, site_num int, label string, x_position double, y_position double, z_position double"
FRAMES = "acq string, p int, t int, c int, z int, ny int, nx int, dtype string, pixels array<int>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames stored by ``sinks.write_frames``; filters on acq, p, t and c prune folders."""
    return spark.read.schema(FRAMES).parquet(path)


def requested(requests: DataFrame, frames: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The frames of the requested volumes (acq, p, t, c), of those that ``read_frames`` reads; t and c wrap.

    Which folders are opened follows at run time from the values of acq, p, t and c that requests name, as long as those are few enough for Spark to
    broadcast them by their size; else both sides are shuffled. A request that is null anywhere finds nothing, one that
    comes twice finds its frames twice. Other columns of requests are kept, under the frames' names they must not be.
    """
    keys = ["acq", "p", "t", "c"]
    if taken := (set(requests.columns) & set(frames.columns)) - set(keys):
        raise ValueError(f"requests have columns of frames: {sorted(taken)}")
    named = requests.withColumns({a: wrapped(F.col(a), n).cast("int") for a, n in sizes.items()})
    # no wrapped index is below zero: the filter tells Spark that requests select
    return frames.join(named.where(F.least(*sizes) >= 0 if len(sizes) > 1 else F.col(*sizes) >= 0), keys)


def replay(requests: DataFrame, frames: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Requested frames; every index of ``sizes`` wraps. A channel that the data lacks reads as zero."""
    keyed = requests.withColumns({f"_{a}": wrapped(F.col(a), n) for a, n in sizes.items()})
    stored = frames.select(*[F.col(a).alias(f"_{a}") for a in sizes], *[c for c in frames.columns if c not in (*sizes, "value")], F.col("value").alias("_value"))
    on = [f"_{a}" for a in sizes] + [c for c in frames.columns if c in requests.columns and c not in sizes and c != "value"]
    return keyed.join(stored, on, "left").withColumn("value", F.coalesce("_value", F.lit(0))).drop("_value", *[f"_{a}" for a in sizes])


def assemble(frames: DataFrame, keys: list[str], order: str, n_z: int) -> DataFrame:
    """Stacks cut after every ``n_z`` arrivals of a key: stack, n, complete, arrivals (in order of arrival)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    cut = frames.withColumn("stack", F.floor(place / F.lit(max(n_z, 1))).cast("long"))
    out = cut.groupBy(*keys, "stack").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("arrivals"))
    return out.withColumn("complete", F.col("n") >= max(n_z, 1))


def zero_padded(grid: DataFrame, frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every event of the grid, zero where no frame arrived."""
    return grid.join(frames.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def read_illumination(spark: SparkSession, path: str) -> DataFrame:
    """Illumination by well; the columns must be exactly the expected ones."""
    found = spark.read.option("header", True).csv(path)
    if set(found.columns) != ILLUMINATION:
        raise ValueError(f"illumination columns must be {sorted(ILLUMINATION)}, not {found.columns}")
    return found.select("well_id", F.col("exposure_time_ms").cast("double").alias("exposure_time_ms"), F.col("laser_power_mW").cast("double").alias("laser_power_mW"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(POSITIONS).csv(path)


def read_platemap(spark: SparkSession, path: str) -> DataFrame:
    """A wide plate map as rows (row, col, sample); empty wells are null."""
    wide = spark.read.option("header", True).csv(path)
    first = wide.columns[0]
    return unpivot(wide.withColumnRenamed(first, "row"), "row", "col", "sample")


def unpivot(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    return wide.unpivot([key], [c for c in wide.columns if c != key], name, value)


def last_logged(lines: DataFrame, keys: list[str], order: str, text: str, pattern: str) -> DataFrame:
    """keys, found: the first group of ``pattern`` in the latest line that has it."""
    hit = lines.withColumn("found", F.regexp_extract(text, pattern, 1)).where(F.col("found") != "")
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return hit.withColumn("_r", latest).where("_r = 1").select(*keys, "found")


def z_scale(metadata_json: str = "metadata"):
    """The z entry of the scale transform in image metadata, 1.0 where there is none."""
    kind = "array<struct<type:string,scale:array<double>>>"
    steps = F.from_json(F.get_json_object(F.col(metadata_json), "$.multiscales[0].datasets[0].coordinateTransformations"), kind)
    scale = F.try_element_at(F.filter(steps, lambda s: s["type"] == "scale"), F.lit(1))["scale"]
    return F.coalesce(F.try_element_at(scale, F.lit(3)), F.lit(1.0))


def position_keys(frames: DataFrame, key: str) -> DataFrame:
    """(p, key): the positions of a dataset in order of their keys; a single one is called 0."""
    keys = frames.select(F.col(key).cast("string").alias("key")).distinct()
    place = F.row_number().over(Window.orderBy("key")) - 1  # a row for each position of a plate
    numbered = keys.withColumn("p", place.cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.select("p", F.when(F.col("n") == 1, "0").otherwise(F.col("key")).alias("key"))


def volume(frames: DataFrame, sizes: dict[str, int], t: int, c: int, position: str) -> DataFrame:
    """The frames of one volume in order of z; t and c wrap, and the filter prunes the folders of ``read_frames``."""
    return frames.where((F.col("p") == position) & (F.col("t") == t % sizes["t"]) & (F.col("c") == c % sizes["c"])).orderBy("z")


def checked_positions(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The requests; reading one whose position is unknown is an error."""
    marked = requests.join(known.select(F.col(key), F.lit(True).alias("_known")), key, "left")
    error = F.raise_error(F.concat(F.lit("unknown position "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(error.cast(requests.schema[key].dataType))).drop("_known")


def current_position(requests: DataFrame, known: DataFrame, keys: list[str], order: str, wanted: str, start: str) -> DataFrame:
    """``position``: the last wanted position that exists, at first ``start``; unknown ones change nothing."""
    marked = requests.join(known.select(F.col("key").alias("_key")), F.col(wanted) == F.col("_key"), "left")
    until_now = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("position", F.coalesce(F.last("_key", ignorenulls=True).over(until_now), F.lit(start))).drop("_key")


def event_positions(events: DataFrame, known: DataFrame, keys: list[str], order: str, start: str) -> DataFrame:
    """``position`` of events (pos_name, p): by name, else by index, else the one before.

    A dataset of one position is never switched.
    """
    single = known.agg((F.count("*") <= 1).alias("_single"))
    by_name = known.select(F.col("key").alias("_name"))
    by_index = known.select(F.col("p").alias("_p"), F.col("key").alias("_key"))
    found = events.join(by_name, F.col("pos_name") == F.col("_name"), "left").join(by_index, F.col("p") == F.col("_p"), "left").join(single)
    until_now = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    switched = F.when(~F.col("_single"), F.coalesce("_name", "_key"))
    return found.withColumn("position", F.coalesce(F.last(switched, ignorenulls=True).over(until_now), F.lit(start))).drop("_name", "_p", "_key", "_single")


def sequenced_slices(events: DataFrame, parts: str, n_z: int) -> DataFrame:
    """A row for each part of a sequenced event, in order, with its z index (not clamped); the centre slice where it has none."""
    rows = events.select("*", F.posexplode(parts).alias("place", "_part"))
    return rows.withColumn("z", F.coalesce(F.col("_part.z").cast("long"), F.lit(n_z // 2).cast("long"))).drop("_part", parts)


def free_running_time(requests: DataFrame, keys: list[str], order: str, n_t: int) -> DataFrame:
    """``t`` of frames that are taken without a plan: it counts up and wraps."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return requests.withColumn("t", wrapped(place, n_t).cast("long"))


def positions_or_current(positions: DataFrame, x: float, y: float, z: float | None, label: str = "FOV0") -> DataFrame:
    """The position list (x, y, z, label), or where the stage stands if it is empty."""
    schema = "x double, y double, z double, label string"
    here = positions.sparkSession.createDataFrame([(x, y, z, label)], schema)
    listed = positions.select("x", "y", "z", "label")
    return listed.unionByName(here.join(listed.agg(F.count("*").alias("_n"))).where("_n = 0").drop("_n"))


def stacked(frames: DataFrame, keys: list[str], z_from: int, z_to: int, value: str) -> DataFrame:
    """keys, slices: the values of z_from up to below z_to in order of z."""
    some = frames.where((F.col("z") >= z_from) & (F.col("z") < z_to))
    rows = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("z", value))).alias("_s"))
    return rows.select(*keys, F.transform("_s", lambda s: s[value]).alias("slices"))


def last_shift(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of a shift log."""
    own = F.struct(*[c for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(own, order).alias("_last")).select(*keys, "_last.*")


def tracked_channel(volumes: DataFrame, keys: list[str], name: str, order: str, wanted: str) -> DataFrame:
    """The volume of the wanted channel of each key, or the first channel where preprocessing made no such."""
    own = F.struct(*[c for c in volumes.columns if c not in keys])
    best = F.min_by(own, F.struct((F.col(name) != wanted).alias("other"), F.col(order)))
    return volumes.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
