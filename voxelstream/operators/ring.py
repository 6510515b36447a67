"""Ring-buffer live view: slots, live volumes and what to follow, from the arrival order of frames.

Writing a slot whose old frame belongs to a volume drops that whole volume. As slots are written in turn, the first
frame of a volume is the first to be overwritten: so the arrivals of a volume fall into generations, each beginning
at an arrival that finds none alive and ending ``n_slots`` arrivals later. That holds whatever order frames come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 16  # values of the order column that are numbered together


def ring_size(cache_mb: float, frame_bytes: int, total_frames: int) -> int:
    return min(max(8, int(cache_mb * 1e6 // frame_bytes)), total_frames)


def numbered(frames: DataFrame, keys: list[str], order: str, name: str, width: int = RANGE) -> DataFrame:
    """``name``: the place of each row of a key, from 0, by a column of whole numbers.

    Rows are numbered inside ranges of the order, to which the counts of earlier ranges are added: no key goes to one
    task, only its ranges do.
    """
    part = F.floor(F.col(order) / F.lit(width))
    ranged = frames.withColumn("_range", part)
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    placed = ranged.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
    return placed.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_range", "_inside", "_before")


def slots(frames: DataFrame, keys: list[str], order: str, n_slots: int, width: int = RANGE) -> DataFrame:
    """``arrival`` (from 0) and ``slot`` of each frame."""
    return numbered(frames, keys, order, "arrival", width).withColumn("slot", F.pmod(F.col("arrival"), F.lit(n_slots)))


def messages(frames: DataFrame, n_grid: int) -> DataFrame:
    """What the viewer is told of each frame (map ``index``): one position of stage and grid, zero for what is missing."""
    at = lambda a: F.coalesce(F.try_element_at("index", F.lit(a)), F.lit(0).cast("long"))
    return frames.withColumns({"position": at("p") * n_grid + at("g"), **{a: at(a) for a in "tzc"}}).drop("index")


def generations(arrived: DataFrame, keys: list[str], volume: list[str], n_slots: int, n_z: int) -> DataFrame:
    """A row for each generation of each volume: ``first`` and ``last`` arrival, ``n_z`` different slices, ``completed``
    (the arrival that made it whole, else null) and ``dies``, the arrival that drops it.

    The arrivals of one volume are held together: a few for each slice.
    """
    held = arrived.groupBy(*keys, *volume).agg(F.array_sort(F.collect_list(F.struct("arrival", "z"))).alias("_all"))
    place = "struct<arrival:bigint,z:bigint>"
    start = F.array().cast(f"array<array<{place}>>")

    def dealt(done: Column, frame: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (frame["arrival"] < F.element_at(last, 1)["arrival"] + n_slots)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(frame))))
        return F.when(F.size(done) == 0, F.array(F.array(frame))).when(joins, grown).otherwise(F.concat(done, F.array(F.array(frame))))

    frames = F.transform("_all", lambda x: F.struct(x["arrival"].alias("arrival"), x["z"].cast("long").alias("z")))
    each = held.select(*keys, *volume, F.explode(F.aggregate(frames, start, dealt)).alias("_g"))
    first = lambda z: F.array_min(F.transform(F.filter("_g", lambda x: x["z"] == z), lambda x: x["arrival"]))
    kinds = F.array_distinct(F.transform("_g", lambda x: x["z"]))
    out = each.select(
        *keys,
        *volume,
        F.element_at("_g", 1)["arrival"].alias("first"),
        F.element_at("_g", -1)["arrival"].alias("last"),
        F.size(kinds).cast("long").alias("n_z"),
        F.when(F.size(kinds) >= n_z, F.array_max(F.transform(kinds, first))).alias("completed"),
    )
    return out.withColumn("dies", F.col("first") + n_slots)


def live_at_end(found: DataFrame, keys: list[str]) -> DataFrame:
    """Generations still in the buffer after the last arrival of their stream."""
    ends = found.groupBy(*keys).agg(F.max("last").alias("end"))
    return found.join(ends, keys).where("dies > end").drop("end")


def follow_target(found: DataFrame, keys: list[str], volume: list[str]) -> DataFrame:
    """The volume that was the last to be whole when one of its frames came: ``seen`` is that arrival."""
    whole = found.where("completed is not null").groupBy(*keys).agg(F.max_by(F.struct(*volume, "last"), "last").alias("_v"))
    return whole.select(*keys, *[f"_v.{c}" for c in volume], F.col("_v.last").alias("seen"))


def complete_planes(arrived: DataFrame, keys: list[str], plane: list[str], n_channels: int) -> DataFrame:
    """keys and plane for which every channel has a frame, and the arrival that brought the last."""
    first = arrived.groupBy(*keys, *plane, "c").agg(F.min("arrival").alias("_first"))
    return first.groupBy(*keys, *plane).agg(F.count("*").alias("_n"), F.max("_first").alias("seen")).where(F.col("_n") >= n_channels).drop("_n")


def read_rows(wanted: DataFrame, frames: DataFrame, row: int, width: int) -> DataFrame:
    """``pixels`` of one row of the wanted slots (place, slot), in any order; zeros for slots that hold nothing.

    ``frames`` has (slot, pixels): whole frames, of which only the row goes on.
    """
    one = frames.select("slot", F.slice("pixels", row * width + 1, width).alias("_row"))
    zeros = F.array_repeat(F.lit(0).cast("int"), width)
    return wanted.join(one, "slot", "left").withColumn("pixels", F.coalesce("_row", zeros)).drop("_row")
