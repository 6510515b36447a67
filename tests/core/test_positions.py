"""The stream from frames to positions against a plain walk over whole stacks; logs that are written once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelstream.operators import register, track
from voxelstream.plans.config import checked
from voxelstream.streaming import assemble, positions

SHAPE, SCALE = (2, 4, 4), {"z": 2.0, "y": 0.5, "x": 0.5}
FRAME = "p long, t long, z long, seq long, data array<double>, x double, y double, z_stage double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, positions.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def settings(method, **more):
    return checked("dynatrack", {"input_channel": "a", "tracking_channel": "a", "tracking_method": method, "image_to_stage_matrix_xyz": [[0, -1, 0], [1, 0, 0], [0, 0, 1]], **more})


def frames_of(stacks, seed=0):
    """(p, t, seq of its first frame, volume, stage) -> frames."""
    return [(p, t, z, seq + z, None if plane is None else [float(v) for v in np.ravel(plane)], *stage) for p, t, seq, volume, stage in stacks for z, plane in enumerate(volume)]


def run(spark, tmp_path, batches, tracking, restart=False):
    """Each list of frames is one file and one micro-batch; a restart makes a new query from the same checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if restart or k == len(batches) - 1:
            stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = positions.follow(stream, tracking, SCALE, SHAPE).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
            query.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return {(r["p"], r["t"], r["seq"]): r for r in spark.read.schema(positions.UPDATES).parquet(f"{tmp_path}/out").collect()}


def walk(stacks, tracking):
    """Whole stacks one after the other; what the stream must give."""
    out, reference, held, seen = {}, {}, {}, set()
    alone = tracking["tracking_method"] in ("intensity_center_of_mass", "roi_center_pcc")
    renew, every = tracking["reference_update_interval"], tracking["tracking_interval"]
    matrix = np.array(tracking["image_to_stage_matrix_xyz"])
    for p, t, seq, volume, stage in stacks:
        due, shift = not alone and bool(renew) and t % renew == 0, [0.0, 0.0, 0.0]
        if (p, t) in seen:
            action = "refresh" if due else "skip"
        else:
            seen.add((p, t))
            action = "anchor" if not alone and (p not in reference or due) else "update" if every <= 1 or t % every == 0 else "rest"
            if any(plane is None for plane in volume):
                action = "failed" if action != "rest" else "rest"
            if p not in held:
                held[p] = stage
        if action in ("anchor", "refresh"):
            reference[p] = (seq + SHAPE[0] - 1, np.array(volume, float))
        if action == "anchor":
            held[p] = stage
        if action == "update":
            ref = None if alone else reference[p][1]
            found = register._shift(tracking["tracking_method"], SHAPE, ref, np.array(volume, float), 1.0, tracking["segmentation"], tracking["roi_center"])
            shift = positions.microns(found, tracking, SCALE)
            held[p] = tuple(b - s for b, s in zip(stage, matrix @ np.array(shift[::-1]), strict=True))
        out[p, t, seq + SHAPE[0] - 1] = (action, reference[p][0] if p in reference else None, *shift, *held[p])
    return out


@pytest.mark.parametrize("method", ["pcc", "multiotsu_pcc", "multiotsu_center_of_mass", "roi_center_pcc", "intensity_center_of_mass"])
def test_stream_as_batch_over_restarts(rocks, tmp_path, method):
    """Frames that come mixed and over several micro-batches, with the query begun anew before each."""
    rng = np.random.default_rng(4)
    tracking = settings(method, reference_update_interval=3, tracking_interval=1 if method == "pcc" else 2, shift={"limits": {"x": [0.1, 0.9]}, "dampening": [0.5, 1.0, 0.9]}, segmentation={"otsu_sigma": 0.5})
    stacks = []
    for t in range(7):
        for p in (1, 2):
            stacks.append((p, t, (t * 2 + p) * 10, rng.random(SHAPE), (100.0 * p + t, 5.0 * t, 7.0)))
    stacks.insert(9, (1, 3, 95, rng.random(SHAPE), (0.0, 0.0, 0.0)))  # a timepoint again: due for a new reference
    stacks.append((2, 4, 300, rng.random(SHAPE), (0.0, 0.0, 0.0)))  # and one that isn't
    stacks.append((2, 8, 310, [np.ones(SHAPE[1:]), None], (9.0, 9.0, 9.0)))  # a plane that was lost
    frames = sorted(frames_of(stacks), key=lambda f: f[3])
    batches = [frames[at : at + 11] for at in range(0, len(frames), 11)]
    for b in batches:
        rng.shuffle(b)
    got = run(rocks, tmp_path, batches, tracking, restart=True)
    want = walk(sorted(stacks, key=lambda s: s[2]), tracking)
    assert set(got) == set(want)
    for key, row in got.items():
        assert (row["action"], row["reference"]) == want[key][:2], key
        assert tuple(row)[5:] == pytest.approx(want[key][2:], abs=1e-9), key


def test_partial_stacks_and_repeated_slices_change_nothing(rocks, tmp_path):
    one = np.arange(32.0).reshape(SHAPE)
    tracking = settings("pcc")
    frames = frames_of([(1, 0, 0, one, (1.0, 2.0, 3.0)), (1, 1, 10, one, (1.5, 2.0, 3.0))])[:-1] + [(1, 2, 0, 20, one[0].ravel().tolist(), 4.0, 4.0, 4.0)] * 2 + frames_of([(1, 3, 30, one, (8.0, 2.0, None))])
    got = run(rocks, tmp_path, [frames], tracking)
    assert {k[1]: r["action"] for k, r in got.items()} == {0: "anchor", 2: "failed", 3: "update"}
    assert [(r["x"], r["y"], r["z"]) for k, r in sorted(got.items())] == [(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (8.0, 2.0, None)]


def test_open_stacks_expire_and_nothing_else(rocks):
    """The machine itself: a stack that stayed open goes, the reference, the position and other stacks stay."""

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

    class Map(dict):
        getValue, containsKey, removeKey = dict.get, dict.__contains__, dict.pop  # noqa: N815

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        iterator = lambda self: iter(list(self.items()))

    class Handle:
        timers = []
        getMapState, getValueState = lambda self, *a: Map(), lambda self, *a: Value()  # noqa: E731, N815

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms

    import pandas as pd

    machine, handle = positions.Follower(settings("pcc"), SCALE, SHAPE, 100), Handle()
    machine.init(handle)
    columns = [c.split()[0] for c in FRAME.split(", ")]
    feed = lambda rows, ms: [r for f in machine.handleInputRows((1,), iter([pd.DataFrame(rows, columns=columns)]), Now(ms)) for r in f.itertuples()]
    one = np.arange(32.0).reshape(SHAPE)
    assert [r.action for r in feed(frames_of([(1, 0, 0, one, (1.0, 2.0, 3.0))]), 10)] == ["anchor"]
    feed(frames_of([(1, 1, 10, one, (1.0, 2.0, 3.0))])[:1], 20)
    feed(frames_of([(1, 2, 20, one, (1.0, 2.0, 3.0))])[:1], 90)
    assert handle.timers == [110, 120, 190]
    list(machine.handleExpiredTimer((1,), Now(120), Now(120)))
    assert list(machine._opened) == [(2,)] and list(machine._frames) == [(2, 0)]
    assert machine._reference.exists() and machine._position.get() == (1.0, 2.0, 3.0) and len(machine._baselines) == 3
    assert [r.action for r in feed(frames_of([(1, 2, 20, one, (1.0, 2.0, 3.0))])[1:], 200)] == ["update"]


def test_a_log_batch_that_runs_again_writes_once(spark, tmp_path):
    rows = [(1, t, 0.5 * t, -1.0, 0.25, 10.0 + t, 5.0, None) for t in range(6)]
    some = spark.createDataFrame(rows, "p long, t long, shift_z double, shift_y double, shift_x double, x double, y double, z double")
    for number, part in ((0, some.where("t < 3")), (1, some.where("t >= 3")), (1, some.where("t >= 3")), (0, some.where("t < 3"))):
        assemble.log_batch(part, number, f"{tmp_path}/log")
    got = assemble.read_shift_log(spark, f"{tmp_path}/log")
    assert sorted((r["t"], r["shift_z"], r["z"], r["batch"]) for r in got.collect()) == [(t, 0.5 * t, None, int(t >= 3)) for t in range(6)]


def test_log_of_a_stream(rocks, tmp_path):
    """From frames over positions to the log, over a restart."""
    one = np.arange(32.0).reshape(SHAPE)
    for k in range(2):
        rows = frames_of([(1, k, 10 * k, np.roll(one, k, 2), (1.0, 2.0, 3.0))])
        rocks.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(FRAME).parquet(f"{tmp_path}/in")
        assemble.to_shift_log(positions.follow(stream, settings("pcc"), SCALE, SHAPE), f"{tmp_path}/log", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = assemble.read_shift_log(rocks, f"{tmp_path}/log").orderBy("t").collect()
    assert [(r["t"], r["shift_x"]) for r in got] == [(0, 0.0), (1, 0.5)]


def test_positions_before(spark):
    """Two timepoints in one set of updates: each event sees what earlier timepoints led to."""
    updates = spark.createDataFrame([(1, 0, 10.0), (1, 2, 12.0), (2, 5, 50.0)], "p long, t long, x double")
    events = spark.createDataFrame([(p, t, k) for p in (1, 2, 3) for t in range(7) for k in range(2)], "p long, t long, k long")
    got = track.positions_before(events, updates, "p", "t", "x").where(F.col("k") == 1).orderBy("p", "t").collect()
    assert [r["x"] for r in got] == [None, 10, 10, 12, 12, 12, 12, *[None] * 6, 50, *[None] * 7]


def test_centres_are_those_of_the_method(spark):
    with pytest.raises(ValueError, match="compare centres"):
        assemble.tracked(spark.range(1), settings("pcc"), SCALE, {})
