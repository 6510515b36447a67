"""Structured Streaming: stacks from frames, corrected positions from stacks, and a live ring of volumes.

State is kept per key: arrivals and values of the open stack, the reference's volume id and last coordinates for
tracking. Stacks close by count, as frames may come in any order and late ones always count; a stack that stays open is
dropped after ``ttl_ms`` of processing time, so that skipped stacks do not pile up. Nothing else expires: counters,
references, coordinates and rings stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def _timeout(ttl_ms: int | None) -> str:
    """Without a limit nothing expires, and a run over all there is comes to its end."""
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _ordered(batches: Iterator[pd.DataFrame], order: str, columns: list[str]) -> list[np.ndarray]:
    """Columns of all rows of a group, in order: a group has few rows, and pandas' own calls cost more than they hold."""
    parts = [[b[c].to_numpy() for c in columns] for b in batches]
    whole = [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
    place = np.argsort(whole[columns.index(order)], kind="stable")
    return [c[place] for c in whole]


NO_LIMIT = GroupStateTimeout.NoTimeout
STACK = "p long, c string, stack long, n int, arrivals array<long>, values array<double>"


def stacks(frames: DataFrame, n_z: int, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Streaming (p, c, seq, v) -> a row for each complete stack of ``n_z`` frames, in order of arrival."""

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the open stack goes, the number of the next one stays
            state.update((state.get[0], [], []))
            return
        stack, seqs, values = state.get if state.exists else (0, [], [])
        seqs, values = ([*held, *new.tolist()] for held, new in zip((seqs, values), _ordered(batches, "seq", ["seq", "v"]), strict=True))
        n = len(seqs) // n_z
        cuts = [slice(k * n_z, (k + 1) * n_z) for k in range(n)]
        state.update((stack + n, seqs[n * n_z :], values[n * n_z :]))
        if ttl_ms is not None and len(seqs) > n * n_z:
            state.setTimeoutDuration(ttl_ms)
        if n:
            p, c = key
            yield pd.DataFrame({"p": p, "c": c, "stack": range(stack, stack + n), "n": n_z, "arrivals": [seqs[k] for k in cuts], "values": [values[k] for k in cuts]})

    return frames.groupBy("p", "c").applyInPandasWithState(
        collect, STACK, "stack long, seqs array<long>, vals array<double>", "append", _timeout(ttl_ms)
    )


TRACK = "p long, t long, reference long, tracked boolean, shift_z double, shift_y double, shift_x double, x double, y double, z double"


def tracked(volumes: DataFrame, tracking: dict, scale: dict[str, float], start: dict[str, float | None]) -> DataFrame:
    """Streaming (p, t, vec_id, c_z, c_y, c_x: centres in pixels) -> shifts in um and the position they lead to.

    ``tracking`` are checked settings of a method that compares centres with a reference's; for all methods, from
    frames on, see ``positions.follow``. Anchors (the first timepoint, and every
    ``reference_update_interval``-th) set the reference and leave the position as it is, as do timepoints between
    those that are tracked. Shifts are limited, dampened and turned to the stage's axes. A volume without a centre
    (its computation failed) changes nothing. The state holds ids and coordinates, never voxels.
    """
    if tracking["tracking_method"] != "multiotsu_center_of_mass":
        raise ValueError(f"{tracking['tracking_method']!r} doesn't compare centres with a reference's")
    renew, every = tracking["reference_update_interval"], tracking["tracking_interval"]
    limits, dampening = tracking["shift"]["limits"] or {}, dict(zip("zyx", tracking["shift"]["dampening"] or (1.0, 1.0, 1.0), strict=True))
    matrix = np.array(tracking["image_to_stage_matrix_xyz"] or np.eye(3))

    def microns(axis: str, pixels: float) -> float:
        um = pixels * scale[axis]
        if axis in limits:
            low, high = limits[axis]
            um = 0.0 if abs(um) < low else float(np.sign(um)) * high if abs(um) > high else um
        return um * dampening[axis]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reference, *held = state.get if state.exists else (None, None, None, None, start["x"], start["y"], start["z"])
        anchor, place, out = held[:3], held[3:], []
        for row in pd.concat(list(batches)).sort_values("t").itertuples():
            centre, shift, moved = (row.c_z, row.c_y, row.c_x), (0.0, 0.0, 0.0), False
            if any(c is None or c != c for c in centre):
                pass
            elif reference is None or renew and row.t % renew == 0:
                reference, anchor = int(row.vec_id), [float(c) for c in centre]
            elif every <= 1 or row.t % every == 0:
                shift, moved = tuple(microns(a, c - r) for a, c, r in zip("zyx", centre, anchor, strict=True)), True
                stage = matrix @ np.array(shift[::-1])
                place = [p if p is None else float(p - s) for p, s in zip(place, stage, strict=True)]
            out.append((key[0], row.t, reference, moved, *shift, *place))
        state.update((reference, *anchor, *place))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACK.split(", ")])

    kept = "reference long, c_z double, c_y double, c_x double, x double, y double, z double"
    return volumes.groupBy("p").applyInPandasWithState(follow, TRACK, kept, "append", NO_LIMIT)


ROWS = 1 << 15  # rows of a live view that are Python objects at a time
LIVE = "c string, arrival long, p long, t long, complete boolean, evicted long"


def live_view(frames: DataFrame, n_slots: int, n_z: int) -> DataFrame:
    """Streaming (c, seq, p, t, z) -> for each frame, whether its volume is whole now and how many volumes it evicts.

    Writing a slot whose old frame belongs to a volume drops that whole volume. Volumes keep the counts of their
    slices, so a frame costs the same whatever the size of the ring; state is bounded by ``n_slots``. A stream (c) is
    one camera's, and in order.
    """

    def view(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = (state.get[0], zip(*state.get[1:], strict=True)) if state.exists else (0, ())
        ring: dict[int, tuple[int, int, int]] = {}  # slot -> frame
        whole: dict[tuple[int, int], dict[int, int]] = {}  # volume -> slot -> slice
        for slot, p, t, z in held:
            ring[slot] = (p, t, z)
            whole.setdefault((p, t), {})[slot] = z
        kinds = {v: Counter(s.values()) for v, s in whole.items()}
        columns, out = ["c", "arrival", "p", "t", "complete", "evicted"], []
        _, *fields = _ordered(batches, "seq", ["seq", "p", "t", "z"])
        for p, t, z in (row for at in range(0, len(fields[0]), ROWS) for row in zip(*(f[at : at + ROWS].tolist() for f in fields), strict=True)):
            slot, volume, evicted = count % n_slots, (p, t), 0
            if slot in ring:
                old, evicted = ring[slot][:2], 1
                for s in whole.pop(old):
                    del ring[s]
                del kinds[old]
            ring[slot] = (*volume, z)
            whole.setdefault(volume, {})[slot] = z
            kinds.setdefault(volume, Counter())[z] += 1
            out.append((key[0], count, *volume, len(kinds[volume]) >= n_z, evicted))
            count += 1
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        held = list(zip(*((s, *f) for s, f in ring.items()), strict=True)) or [(), (), (), ()]
        state.update((count, *map(list, held)))
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("c").applyInPandasWithState(
        view, LIVE, "count long, slot array<long>, p array<long>, t array<long>, z array<long>", "append", NO_LIMIT
    )


def to_shift_log(rows: DataFrame, path: str, checkpoint: str):
    """Append what ``tracked`` or ``positions.follow`` gives to a CSV log, each micro-batch once: see ``log_batch``."""
    return rows.writeStream.foreachBatch(lambda batch, number: log_batch(batch, number, path)).option("checkpointLocation", checkpoint)


def log_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch to the folder of its number. A batch that is run again replaces what it wrote before."""
    text = [F.format_string("%.4f", c).alias(c) for c in ("shift_z", "shift_y", "shift_x", "x", "y", "z")]
    batch.select("p", "t", *text).write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")


def read_shift_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the log with the number of their micro-batch."""
    schema = "p long, t long, shift_z double, shift_y double, shift_x double, x double, y double, z double, batch long"
    return spark.read.option("header", True).schema(schema).csv(path)


TIMER = "p long, seq long, due boolean, waited double"


def refocus_timer(attempts: DataFrame, interval_s: float) -> DataFrame:
    """Streaming (p, seq, s, ok) -> whether a refocus is due at time ``s``, and how long since the last success.

    It is due when more than the interval has passed; only an attempt that is due and succeeds starts the time anew.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            last = row.s if last is None else last
            waited = float(row.s - last)
            due = waited > interval_s
            out.append((key[0], row.seq, due, waited))
            last = row.s if due and row.ok else last
        state.update((float(last),))
        yield pd.DataFrame(out, columns=["p", "seq", "due", "waited"])

    return attempts.groupBy("p").applyInPandasWithState(follow, TIMER, "last double", "append", NO_LIMIT)
