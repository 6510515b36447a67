"""From frames to corrected positions in one stream: a state machine for each position.

Frames are counted into stacks; the stage position that the first frame of a timepoint brings is its baseline. When a
stack is whole, its baseline is taken, and the stack sets the reference, corrects the position, or is passed over. What
fails leaves the position as it was. State: the open stacks' frames (at most a stack for each open timepoint), the
reference volume, the baselines and the position. Open stacks may expire; references, baselines that were taken and
positions never do.

Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.register import _shift
from ..plans.config import REFERENCELESS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATES = "p long, t long, seq long, action string, reference long, shift_z double, shift_y double, shift_x double, x double, y double, z double"
AXES = ("x", "y", "z")


def microns(shift: list[float], tracking: dict, scale: dict[str, float]) -> list[float]:
    """Pixel shifts (z, y, x) -> micrometres: scaled, limited, then dampened."""
    limits, dampening = tracking["shift"]["limits"] or {}, tracking["shift"]["dampening"] or (1.0, 1.0, 1.0)
    out = []
    for axis, pixels, damp in zip("zyx", shift, dampening, strict=True):
        um = float(pixels) * scale[axis]
        if axis in limits:
            low, high = limits[axis]
            um = 0.0 if abs(um) < low else float(np.sign(um)) * high if abs(um) > high else um
        out.append(um * damp)
    return out


class Follower(StatefulProcessor):
    """The state machine of one position.

    A whole stack of timepoint t: with a baseline it is an ``anchor`` (the first one, or due for a new reference; its
    baseline becomes the position) or an ``update`` (the baseline less the shift), between tracked timepoints ``rest``.
    A second whole stack of a timepoint has no baseline: it is a ``refresh`` if t is due for a new reference, else
    ``skip``; a position that was never written makes it a ``drop``. ``failed`` has no shift and keeps the position.
    Referenceless methods correct from the first stack on and keep no reference.
    """

    def __init__(self, tracking: dict, scale: dict[str, float], shape: tuple[int, int, int], ttl_ms: int | None):
        self._tracking, self._scale, self._shape, self._ttl = tracking, scale, shape, ttl_ms
        self._matrix = np.array(tracking["image_to_stage_matrix_xyz"] or np.eye(3))
        self._alone = tracking["tracking_method"] in REFERENCELESS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._frames = handle.getMapState("frames", "t long, k long", "z long, data array<double>")
        self._opened = handle.getMapState("opened", "t long", "n long, since long")
        self._baselines = handle.getMapState("baselines", "t long", "x double, y double, z double, taken boolean")
        self._reference = handle.getValueState("reference", "seq long, data array<double>")
        self._position = handle.getValueState("position", "x double, y double, z double")

    def _due(self, t: int) -> bool:
        every = self._tracking["reference_update_interval"]
        return not self._alone and bool(every) and t % every == 0

    def _stack(self, t: int, n: int) -> np.ndarray | None:
        """The frames of an open stack by z, which are given up; None if they aren't one of each slice."""
        planes: dict[int, Any] = {}
        for k in range(n):
            z, data = self._frames.getValue((t, k))
            planes[z] = data
            self._frames.removeKey((t, k))
        self._opened.removeKey((t,))
        if sorted(planes) != list(range(self._shape[0])) or any(d is None or len(d) != self._shape[1] * self._shape[2] for d in planes.values()):
            return None
        return np.array([planes[z] for z in sorted(planes)], np.float64).reshape(self._shape)

    def _whole(self, t: int, seq: int, n: int) -> tuple:
        stack, shift = self._stack(t, n), (0.0, 0.0, 0.0)
        *base, taken = self._baselines.getValue((t,))
        held = self._position.get() if self._position.exists() else None
        reference = self._reference.get() if self._reference.exists() else None
        if taken:
            action = "drop" if held is None else "refresh" if self._due(t) else "skip"
        else:
            self._baselines.updateValue((t,), (*base, True))
            anchor = not self._alone and (reference is None or self._due(t))
            every = self._tracking["tracking_interval"]
            action = "anchor" if anchor else "update" if every <= 1 or t % every == 0 else "rest"
        if stack is None and action in ("anchor", "refresh", "update"):
            action = "failed"
        if action in ("anchor", "refresh"):
            reference = (seq, stack.ravel().tolist())
            self._reference.update(reference)
        if action == "anchor":
            held = tuple(base)
        if action == "update":
            try:
                other = None if self._alone else np.array(reference[1]).reshape(self._shape)
                found = _shift(self._tracking["tracking_method"], self._shape, other, stack, self._tracking["shift"]["maximum"], self._tracking["segmentation"], self._tracking["roi_center"])
                shift = microns(found, self._tracking, self._scale)
                stage = self._matrix @ np.array(shift[::-1])
                held = tuple(b if b is None or b != b else float(b - s) for b, s in zip(base, stage, strict=True))
            except (ValueError, TypeError, ArithmeticError):
                action = "failed"
        if held is None and not taken:
            held = tuple(base)
        if held is not None:
            self._position.update(held)
        return t, seq, action, None if reference is None else reference[0], *shift, *(held or (None,) * 3)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            t = int(row.t)
            if not self._baselines.containsKey((t,)):
                self._baselines.updateValue((t,), (*(None if c is None or c != c else float(c) for c in (row.x, row.y, row.z_stage)), False))
            now = timerValues.getCurrentProcessingTimeInMs() if self._ttl else 0
            n, since = self._opened.getValue((t,)) if self._opened.containsKey((t,)) else (0, now)
            if self._ttl and n == 0:
                self._handle.registerTimer(now + self._ttl)
            self._frames.updateValue((t, n), (int(row.z), None if row.data is None else [float(v) for v in row.data]))
            self._opened.updateValue((t,), (n + 1, since))
            if n + 1 == self._shape[0]:
                out.append((key[0], *self._whole(t, int(row.seq), n + 1)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in UPDATES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Give up stacks that have been open for the whole time limit; nothing else."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self._ttl
        for (t,), (n, since) in list(self._opened.iterator()):
            if since <= until:
                self._stack(t, n)
        yield pd.DataFrame([], columns=[c.split()[0] for c in UPDATES.split(", ")])

    def close(self) -> None:
        pass


def follow(frames: DataFrame, tracking: dict, scale: dict[str, float], shape: tuple[int, int, int], ttl_ms: int | None = None) -> DataFrame:
    """Streaming (p, t, z, seq, data: a plane, x, y, z_stage) -> a row for each whole stack: see ``Follower``.

    ``tracking`` are checked settings, of any method; ``shape`` is that of a stack. Frames of a position come in the
    order of ``seq`` from one micro-batch to the next, and in any order inside one. With ``ttl_ms`` stacks that stay
    open so long (processing time) are given up.
    """
    return frames.groupBy("p").transformWithStateInPandas(Follower(tracking, scale, shape, ttl_ms), UPDATES, "append", "ProcessingTime" if ttl_ms else "None")
