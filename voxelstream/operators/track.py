"""Drift tracking in batch: anchors, as-of references, shift limits, axis maps and corrected positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expand import upsert_property


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: what a baseline keeps."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def is_anchor(keys: list[str], t: str, interval: int) -> Column:
    """First timepoint of a position, or every ``interval``-th (0: only the first)."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(t)) == 1
    return first | (F.pmod(F.col(t), F.lit(interval)) == 0) if interval else first


def as_of_reference(volumes: DataFrame, keys: list[str], t: str, volume: str, interval: int) -> DataFrame:
    """``anchor`` and ``reference``: the latest anchor volume at or before each timepoint. One shuffle by position."""
    until_now = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    marked = volumes.withColumn("anchor", is_anchor(keys, t, interval))
    return marked.withColumn("reference", F.last(F.when(F.col("anchor"), F.col(volume)), ignorenulls=True).over(until_now))


def tracked(anchor: Column, t: Column, tracking_interval: int, referenceless: bool = False) -> Column:
    """Whether a volume is corrected: anchors are not (unless no reference is used), then every k-th timepoint."""
    on_time = F.pmod(t, F.lit(tracking_interval)) == 0 if tracking_interval > 1 else F.lit(True)
    return on_time if referenceless else ~anchor & on_time


def limited(shift: Column, bounds: tuple[float, float] | None) -> Column:
    """Zero below the least shift, cut to the greatest; both bounds themselves are in range."""
    if bounds is None:
        return shift
    low, high = bounds
    return F.when(F.abs(shift) < low, 0.0).when(F.abs(shift) > high, F.signum(shift) * high).otherwise(shift)


def shift_um(pixels: dict[str, Column], scale: dict[str, float], limits: dict[str, tuple[float, float]] | None = None, dampening: dict[str, float] | None = None) -> dict[str, Column]:
    """Pixel shifts by axis -> micrometres: scaled, limited, then dampened."""
    return {a: limited(p * scale[a], (limits or {}).get(a)) * (dampening or {}).get(a, 1.0) for a, p in pixels.items()}


def to_stage(shift: dict[str, Column], matrix: list[list[float]] | None) -> dict[str, Column]:
    """Image shifts in x, y, z -> stage shifts."""
    axes = ("x", "y", "z")
    if matrix is None:
        return {a: shift[a] for a in axes}
    return {a: sum((shift[b] * float(matrix[i][j]) for j, b in enumerate(axes)), F.lit(0.0)) for i, a in enumerate(axes)}


def corrected(baseline: dict[str, Column], stage_shift: dict[str, Column]) -> dict[str, Column]:
    """Baseline minus shift; a null height stays null, and a null shift (its computation failed) moves nothing."""
    return {a: baseline[a] - F.coalesce(stage_shift[a], F.lit(0.0)) for a in ("x", "y", "z")}


def recurrence(rows: DataFrame, keys: list[str], t: str, start: Column, shift: Column, name: str) -> DataFrame:
    """Simulated positions: the start minus the running sum of shifts."""
    until_now = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, start - F.sum(shift).over(until_now))


def latest(store: DataFrame, version: str) -> DataFrame:
    """(p, x, y, z) as last written."""
    return store.groupBy("p").agg(F.max_by(F.struct("x", "y", "z"), version).alias("_s")).select("p", "_s.*")


def positions_before(events: DataFrame, updates: DataFrame, p: str, t: str, value: str) -> DataFrame:
    """Events with ``value`` as the latest update of an earlier timepoint left it; null without any.

    The barrier of timepoints: what timepoint t leads to is seen from t + 1 on, never inside t. The window holds one
    row for each timepoint of a position, however many events it has; those meet it by position and timepoint.
    """
    latest_of_t = updates.groupBy(p, t).agg(F.max(value).alias("_u"))
    moments = events.select(p, t).distinct().withColumn("_event", F.lit(True))
    both = moments.unionByName(latest_of_t.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    earlier = Window.partitionBy(p).orderBy(t).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.last("_u", ignorenulls=True).over(earlier)).where("_event").select(p, t, F.col("_seen").alias(value))
    return events.join(seen, [p, t], "left")


def override_positions(events: DataFrame, store: DataFrame, z_device: str | None = None) -> DataFrame:
    """Event coordinates from the position store; unknown positions keep the event's own.

    With a z device its Position property is set instead of ``z_pos``. The store has a row a position: see ``latest``.
    """
    own = store.select("p", *[F.col(a).alias(f"_{a}") for a in ("x", "y", "z")])
    axes = ("x", "y") if z_device else ("x", "y", "z")
    moved = events.join(own, "p", "left").withColumns({f"{a}_pos": F.coalesce(f"_{a}", f"{a}_pos") for a in axes})
    if z_device:
        moved = moved.withColumn("properties", F.when(F.col("_z").isNull(), F.col("properties")).otherwise(upsert_property(F.col("properties"), z_device, "Position", F.col("_z"))))
    return moved.drop("_x", "_y", "_z")


def wants_refresh(t: Column, interval: int, referenceless: bool = False) -> Column:
    """Whether a timepoint is due for a new reference."""
    return F.lit(False) if referenceless or not interval else F.pmod(t, F.lit(interval)) == 0


def completed(stacks: DataFrame, baselines: DataFrame, store: DataFrame, order: str, interval: int, referenceless: bool = False) -> DataFrame:
    """What happens with each complete stack (p, t), and ``x``, ``y``, ``z`` that it starts from.

    A baseline (p, t, x, y, z) serves the first stack of its key. Without one, stacks of positions that the store
    lacks are dropped, others are skipped, but for those due for a new reference, which take the store's position.
    """
    place = F.row_number().over(Window.partitionBy("p", "t").orderBy(order))
    taken = baselines.select("p", "t", F.lit(1).alias("_n"), F.struct("x", "y", "z").alias("_base"))
    known = store.select("p", F.struct("x", "y", "z").alias("_live"))
    rows = stacks.withColumn("_n", place).join(taken, ["p", "t", "_n"], "left").join(known, "p", "left")
    refresh = wants_refresh(F.col("t"), interval, referenceless)
    action = F.when(F.col("_base").isNotNull(), "update").when(F.col("_live").isNull(), "drop").when(refresh, "refresh").otherwise("skip")
    start = F.when(F.col("action") == "update", F.col("_base")).when(F.col("action") == "refresh", F.col("_live"))
    return rows.withColumn("action", action).withColumn("_start", start).select(*stacks.columns, "action", "_start.x", "_start.y", "_start.z")
