from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelstream.operators import control, exposure, preprocess, ring, stats, track
from voxelstream.plans import config, expand
from voxelstream.sources import frames, shared, sinks


TRACKED = {"input_channel": "BF", "tracking_channel": "BF"}


def test_settings_are_strict():
    found = config.checked("metadata", {"reset_hardware_sequencing_settings": [["Cam", "Mode", 3]], "dynatrack": TRACKED})
    assert found["reset_hardware_sequencing_settings"] == [("Cam", "Mode", "3")] and found["autofocus"]["enabled"] is False
    assert found["dynatrack"]["shift"] == {"dampening": None, "limits": None, "maximum": 1.0}
    for bad in ({"unknown": 1}, {"preprocessing": ["sharpen"]}, {"tracking_method": "x"}, {"shift": {"limits": {"t": [0, 1]}}}, {"shift": {"dampening": [1, 2]}}, {"enabled": "yes"}, {"input_channel": 3}):
        with pytest.raises(ValueError):
            config.checked("dynatrack", TRACKED | bad)
    with pytest.raises(ValueError, match="missing"):
        config.checked("dynatrack", {"input_channel": "a"})
    with pytest.raises(ValueError):
        config.checked("metadata", {"tracking": {}})


PLANS = {
    "tracked": """
channels: [{config: BF, exposure: 20}, {config: GFP, exposure: 50}]
z_plan: {range: 12, step: 0.5}
metadata:
  reset_hardware_sequencing_settings: [[Cam, Mode, 3]]
  autofocus: {enabled: true, stage: Z}
  dynatrack:
    input_channel: GFP
    tracking_channel: GFP
    tracking_method: multiotsu_pcc
    segmentation: {otsu_sigma: 2, otsu_component: 1}
    shift: {limits: {z: [0.5, 4], x: [1, 9.5]}, dampening: [1, 0.5, 0.5]}
    preprocessing: [flatfield]
""",
    "stained": """
channels: [{config: BF}]
metadata:
  dynatrack:
    input_channel: BF
    tracking_channel: nuclei
    preprocessing: [vs, phase]
    virtual_staining: {target_channels: [nuclei]}
    phase: {transfer_function: {wavelength: 0.5}}
""",
    "plain": "channels: [{config: BF}]\nmetadata: {autofocus: {enabled: false}}\n",
    "bare": "channels: [{config: BF}]\n",
}


@pytest.mark.parametrize("name", PLANS)
def test_settings_in_yaml(tmp_path, name):
    (tmp_path / "plan.yaml").write_text(PLANS[name])
    plan = config.read_plan(str(tmp_path / "plan.yaml"))
    tracking = plan["metadata"]["dynatrack"]
    assert plan["channels"] and plan["metadata"]["autofocus"]["method"] is None and (tracking is None) == (name in ("plain", "bare"))
    if tracking:
        assert config.tracking_channel(tracking, [c["config"] for c in plan["channels"]]) == {"tracked": 1, "stained": 0}[name]
    if name == "tracked":
        assert {a: tuple(v) for a, v in tracking["shift"]["limits"].items()} == {"z": (0.5, 4.0), "x": (1.0, 9.5)} and list(tracking["shift"]["dampening"]) == [1.0, 0.5, 0.5]
        assert tracking["segmentation"] == {"otsu_component": 1, "otsu_sigma": 2.0}
    if name == "stained":
        scaled = config.tracking_plan(tracking, 3, 0.2, 0.5)
        assert scaled["phase"]["transfer_function"] == {"wavelength": 0.5, "yx_pixel_size": 0.2, "z_pixel_size": 0.5}


def test_sequences_that_devices_cannot_hold():
    assert not control.sequenced_too_long(600, 2) and control.sequenced_too_long(601, 2) and control.sequenced_too_long(3, 2, most=5)


def test_old_settings_are_refused(tmp_path):
    old, new = tmp_path / "old.json", tmp_path / "new.json"
    old.write_text('{"metadata": {"mantis": {"autofocus": {}}}}')
    new.write_text('{"channels": [], "metadata": null}')
    with pytest.raises(ValueError, match="metadata.mantis"):
        config.read_plan(str(old))
    assert config.read_plan(str(new))["metadata"]["dynatrack"] is None


def test_tracking_channel_and_plan():
    settings = config.checked("dynatrack", TRACKED | {"deskew": {"ls_angle_deg": 30}, "phase": {}})
    assert config.tracking_channel(settings, ["GFP", "BF"]) == 1
    stained = {"preprocessing": ["phase", "vs"], "tracking_channel": "nuclei"}
    assert config.tracking_channel(settings | stained, ["BF"]) == 0
    for bad in ({"tracking_channel": "phase"}, {"tracking_channel": "vs_x"}, {"tracking_channel": "nuclei"}, {"input_channel": "RFP"}, stained | {"tracking_channel": "BF"}, stained | {"virtual_staining": {"target_channels": ["m"]}}):
        with pytest.raises(ValueError):
            config.tracking_channel(settings | bad, ["BF"])
    plan = config.tracking_plan(settings, 3, 0.1, 0.2)
    assert plan["deskew"]["scan_step_um"] == 0.2 and plan["phase"]["transfer_function"] == {"yx_pixel_size": 0.1, "z_pixel_size": 0.2}
    assert settings["deskew"] == {"ls_angle_deg": 30} and settings["phase"] == {}
    assert config.tracking_plan(settings | {"enabled": False}, 3, None, None) is None and config.tracking_plan(None, 3, 1, 1) is None and config.tracking_plan(settings, 0, 1, 1) is None
    for scales in ((0, 1), (None, 1), (1, None)):
        with pytest.raises(ValueError):
            config.tracking_plan(settings, 1, *scales)


def test_z_parameters_and_channels():
    assert config.z_parameters(None, None, None, None) == [] and config.z_parameters("z", -1, 1, 0.143)
    for bad in (("z", None, 1, 1), ("z", 0, 1, 0.05)):
        with pytest.raises((TypeError, ValueError)):
            config.z_parameters(*bad)
    assert config.per_channel(5, 3) == [5, 5, 5] and config.per_channel([1, 2], 2) == [1, 2]
    with pytest.raises(ValueError):
        config.per_channel([1], 2)
    assert config.accepted({"a": 1, "b": 2}, {"b", "c"}) == {"b": 2}


def test_expand_order(spark):
    rows = expand.expand(spark, {"t": 2, "p": 3, "c": 2, "z": 4}, "tpcz").orderBy("seq").collect()
    assert len(rows) == 48 and tuple(rows[0][1:]) == (0, 0, 0, 0) and tuple(rows[-1][1:]) == (1, 2, 1, 3)
    assert [r["z"] for r in rows[:5]] == [0, 1, 2, 3, 0]


def test_z_plan_overshoots(spark):
    plans = spark.createDataFrame([(-89.0, 89.0, 15.0)], "a double, b double, s double")
    z = [r["z_um"] for r in expand.z_slices(plans, "a", "b", "s").orderBy("z").collect()]
    assert len(z) == 13 and z[0] == -89 and z[-1] == 91


def test_failing_wildcards(spark):
    events = expand.expand(spark, {"t": 5, "p": 3}, "tp")
    schema = "t long, p long"
    entries = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 0), (4, 1)], schema)
    assert expand.failing(events, entries, ["t", "p"]).count() == 5
    assert expand.failing(events, spark.createDataFrame([(None, None)], schema), ["t", "p"]).count() == 15
    assert expand.failing(events, spark.createDataFrame([], schema), ["t", "p"]).count() == 0


@pytest.mark.parametrize("shift,bounds,want", [(0.5, (1, 10), 0), (15.0, (0.1, 10), 10), (-12.0, (0.1, 10), -10), (8.0, (0.1, 10), 8), (0.01, None, 0.01), (10.0, (1, 10), 10)])
def test_limits(spark, shift, bounds, want):
    assert spark.range(1).select(track.limited(F.lit(shift), bounds)).first()[0] == want


def test_exposure_suggestion(spark):
    power, exp = exposure.suggest(F.lit(1), F.lit(50.0), F.lit(5.0), power_range=(1.0, 10.0), power_step=2.5, max_exposure=100.0, exposure_step=10.0)
    assert tuple(spark.range(1).select(power, exp).first()) == (2.0, 50.0)


def test_ring(spark):
    assert ring.ring_size(1, 1000, 10_000) == 1000 and ring.ring_size(0, 1000, 4) == 4 and ring.ring_size(0, 1000, 100) == 8


def test_frames_round_trip(spark, tmp_path):
    rows = [("a", p, t, 0, z, 1, 1, "uint16", [p * 30000 + t * 10000 + z]) for p in range(2) for t in range(2) for z in range(3)]
    path = str(tmp_path / "frames")
    sinks.write_frames(spark.createDataFrame(rows, frames.FRAMES), path, ["BF"], (2.0, 0.5, 0.5))
    read = frames.read_frames(spark, path).where("p = 1 and t = 1")
    assert sorted(r["pixels"][0] for r in read.collect()) == [40000, 40001, 40002]
    found = frames.volume(frames.read_frames(spark, path), {"t": 2, "c": 1}, -1, 3, 1)
    assert [r["pixels"][0] for r in found.collect()] == [40000, 40001, 40002]
    meta = spark.read.text(f"{path}.metadata").toDF("metadata")
    assert meta.select(frames.z_scale()).first()[0] == 2.0
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_frames(spark.createDataFrame(rows, frames.FRAMES), path, ["BF"])


def test_csv_readers(spark, tmp_path):
    good, bad, plate = (tmp_path / n for n in ("good.csv", "bad.csv", "plate.csv"))
    good.write_text("well_id,exposure_time_ms,laser_power_mW\nA1,10,2.5\n")
    bad.write_text("well_id,exposure_time_ms,laser_power\nA1,10,2.5\n")
    plate.write_text("Row/Column,1,2\nA,x,\nB,,y\n")
    assert tuple(frames.read_illumination(spark, str(good)).first()) == ("A1", 10.0, 2.5)
    with pytest.raises(ValueError):
        frames.read_illumination(spark, str(bad))
    assert {tuple(r) for r in frames.read_platemap(spark, str(plate)).collect()} == {("A", "1", "x"), ("A", "2", None), ("B", "1", None), ("B", "2", "y")}


def test_preprocessing(spark):
    volumes = spark.createDataFrame([(3, 1, 2, [1.0, 10.0, 2.0, 20.0, 3.0, 30.0])], "nz int, ny int, nx int, voxels array<double>")
    flat = preprocess.pipeline(["flatfield"])(volumes).first()["voxels"]
    assert flat == pytest.approx([5.5, 5.5, 11, 11, 16.5, 16.5])
    dark = spark.createDataFrame([(3, 1, 2, [0.0, 10.0, 0.0, 20.0, 5.0, 30.0])], volumes.schema)
    assert preprocess.pipeline(["flatfield"])(dark).first()["voxels"] == [None, 5.0, None, 10.0, None, 15.0]
    assert preprocess.pipeline(["deskew"])(volumes).first()["nz"] == 3
    assert preprocess.pipeline(["deskew"], {"angle_degrees": 30.0, "ratio": 0.5})(volumes).first()["nx"] == 2
    with pytest.raises(ValueError):
        preprocess.pipeline(["phase"])


def test_override_and_changes(spark):
    events = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (9, 4.0, 5.0, None)], "p long, x_pos double, y_pos double, z_pos double")
    store = spark.createDataFrame([(0, 100.0, 200.0, None)], "p long, x double, y double, z double")
    assert {tuple(r) for r in track.override_positions(events, store).collect()} == {(0, 100.0, 200.0, 3.0), (9, 4.0, 5.0, None)}
    moves = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 10.0), (3, 20.0), (4, 9000.0)], "s long, x double").withColumn("y", F.lit(0.0)).withColumn("k", F.lit(1))
    found = control.stage_speed(moves, ["k"], "s", "x", "y").orderBy("s").collect()
    assert [(r["speed"], r["change"]) for r in found] == [(None, False), (None, False), (2.0, True), (2.0, False), (5.75, True)]


def test_exposure_loop_ends(spark):
    start = spark.createDataFrame([(k, 50.0, 5.0) for k in range(4)], "k int, exposure double, power double")
    measure = lambda rows: rows.select("k", F.when(F.col("k") == 0, 0).when(F.col("k") == 1, 1).when(F.col("k") == 2, -1).alias("flag"))
    limits = {"exposure_range": (10.0, 50.0), "power_range": (1.0, 9.0), "power_step": 4.0, "exposure_step": 10.0}
    found = {r["k"]: (r["exposure"], r["power"], r["state"]) for r in exposure.adjust(start, measure, ["k"], 5, **limits).collect()}
    assert found[0] == (50.0, 5.0, "found") and found[3] == (50.0, 5.0, "failed")
    assert found[1] == (50.0, 1.0, "limit") and found[2] == (50.0, 9.0, "limit")


def test_refocus_timer(spark):
    from voxelstream.plans import lens_queries
    from voxelstream.sources import lens

    sf = "/root/testdata/sf0.001"
    got = {(r["p"], r["seq"]): (r["due"], r["waited"]) for r in lens_queries.stream_refocus_timer(spark, sf).collect()}
    want, last = {}, {}
    for r in lens.frames(spark, sf).orderBy("seq").collect():
        s = r["seq"] * 60.0
        waited = s - last.setdefault(r["p"], s)
        want[r["p"], r["seq"]] = (waited > 3600, waited)
        if waited > 3600 and r["v"] > 250:
            last[r["p"]] = s
    assert got == want and any(d for d, _ in got.values())


def test_unknown_positions_raise(spark):
    known = spark.createDataFrame([("A/1/0",), ("A/2/0",)], "key string")
    good = frames.checked_positions(spark.createDataFrame([("A/1/0", 1)], "key string, t int"), known, "key")
    assert [tuple(r) for r in good.select("key", "t").collect()] == [("A/1/0", 1)]
    with pytest.raises(Exception, match="unknown position"):
        frames.checked_positions(spark.createDataFrame([("B/1/0", 1)], "key string, t int"), known, "key").collect()


def test_shift_log_has_its_names_once(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda p, t, z: spark.createDataFrame([(p, t, 0.5, 0.25, -0.125, 1.0, 2.0, z)], "position_index long, timepoint_index long, shift_z_um double, shift_y_um double, shift_x_um double, stage_x double, stage_y double, stage_z double")
    for p, t, z in ((0, 0, 3.0), (0, 1, None), (1, 0, 4.0)):
        sinks.write_shift_log(row(p, t, z), path)
    lines = [r[0] for r in spark.read.text(path, recursiveFileLookup=True).collect()]
    assert sum(line.startswith("position_index") for line in lines) == 1 and len(lines) == 4
    assert {(r["position_index"], r["timepoint_index"], r["shift_x_um"], r["stage_z"]) for r in sinks.read_shift_log(spark, path).collect()} == {(0, 0, -0.125, 3.0), (0, 1, -0.125, None), (1, 0, -0.125, 4.0)}
    archive = str(tmp_path / "old")
    sinks.write_archived_log(row(0, 0, 3.0), archive)
    sinks.write_archived_log(row(0, 1, 3.0), archive)
    found = spark.read.option("header", True).csv(archive).orderBy("TimepointID").collect()
    assert [(r["ShiftZ"], r["StageX"]) for r in found] == [("0.0", "1.0"), ("0.5", "1.0")]
    sinks.write_archived_log(row(0, 2, 3.0), archive, overwrite=True)
    assert spark.read.option("header", True).csv(archive).count() == 1


def brute_ring(arrivals, n_slots, n_z):
    """What a live view does, frame by frame: (whole, evicted) of each arrival, and the last whole volume."""
    slots, out, target = {}, [], None
    for k, (volume, z) in enumerate(arrivals):
        evicted = 0
        if k % n_slots in slots:
            old = slots[k % n_slots][0]
            slots, evicted = {s: f for s, f in slots.items() if f[0] != old}, 1
        slots[k % n_slots] = (volume, z)
        whole = len({f[1] for f in slots.values() if f[0] == volume}) >= n_z
        target = volume if whole else target
        out.append((whole, evicted))
    return out, target, {f[0] for f in slots.values()}


@pytest.mark.parametrize("seed,n_slots,n_z", [(0, 8, 3), (1, 5, 2), (2, 16, 4), (3, 3, 4)])
def test_ring_against_brute_force(spark, seed, n_slots, n_z):
    rng = np.random.default_rng(seed)
    arrivals = [((int(rng.integers(0, 2)), int(k // 7 + rng.integers(0, 3))), int(rng.integers(0, n_z))) for k in range(150)]
    frames_in = spark.createDataFrame([("a", 3 * k, p, t, z) for k, ((p, t), z) in enumerate(arrivals)], "c string, seq long, p long, t long, z long")
    want, target, alive = brute_ring(arrivals, n_slots, n_z)
    arrived = ring.slots(frames_in, ["c"], "seq", n_slots, 32)
    assert [r["arrival"] for r in arrived.orderBy("seq").collect()] == list(range(150))
    found = ring.generations(arrived, ["c"], ["p", "t"], n_slots, n_z).cache()
    assert {(r["p"], r["t"]) for r in ring.live_at_end(found, ["c"]).collect()} == alive
    follow = ring.follow_target(found, ["c"], ["p", "t"]).collect()
    assert [(r["p"], r["t"]) for r in follow] == ([target] if target else [])
    deaths = {r["dies"] for r in found.collect()}
    assert [int(k in deaths) for k in range(150)] == [e for _, e in want]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in range(3) for v in rng.choice([0.0, 1.5, *rng.normal(size=40)], rng.integers(1, 300))] + [(9, 2.0)] * 5
    found = stats.exact_percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.25, "b": 0.75, "c": 1.0}, bins=16)
    for r in found.collect():
        own = [v for k, v in rows if k == r["k"]]
        assert (r["a"], r["b"], r["c"]) == pytest.approx(tuple(np.percentile(own, (25, 75, 100))))
    assert found.count() == 4


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name: None)
    context = SimpleNamespace(master="yarn", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_path(SimpleNamespace(sparkContext=context), "x")


def test_time_plans(spark):
    rows = [("a", 2.0, 3, None), ("b", 2.0, None, 5.0), ("c", 2.0, None, 4.0), ("d", 0.0, None, 4.0), ("e", 0.0, 2, None), ("f", 1.0, None, None), ("g", 1.0, 2, 2.0), ("h", 1.0, 0, None)]
    got = expand.time_plans(spark.createDataFrame(rows, "k string, i double, n int, d double"), "i", "n", "d").collect()
    assert sorted((r["k"], r["t"], r["start_s"]) for r in got) == [*[(k, t, 2.0 * t) for k in "abc" for t in range(3)], ("e", 0, 0.0), ("e", 1, 0.0)]


def test_a_live_view_comes_in_parts_in_order(spark, monkeypatch):
    """A camera's whole stream was one group of one micro-batch, all of it Python objects."""
    import duckdb
    from voxelstream.plans import lens_queries
    from voxelstream.streaming import assemble

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(lens_queries, "BATCH", 150)
    monkeypatch.setattr(assemble, "ROWS", 7)
    stream = lens_queries._streamed_in_order(spark, lens_queries.lens.frames(spark, folder).select("c", "seq", "p", "t", "z"), "seq", "frames")
    seen = []

    def note(batch, number):
        seen.append(tuple(batch.selectExpr("min(seq)", "max(seq)", "count(*)").first()))

    stream.writeStream.foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False)) and sum(n for *_, n in seen) == 1000
    got = lens_queries.QUERIES["stream_live"](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({lens_queries.ORACLE_SQL['stream_live']})").fetchall())


def test_rows_of_a_group_are_ordered_over_its_batches():
    import pandas as pd
    from voxelstream.streaming import assemble

    parts = [pd.DataFrame({"p": 1, "seq": [5, 2], "v": [0.5, 0.2]}), pd.DataFrame({"p": 1, "seq": [3], "v": [0.3]})]
    assert [c.tolist() for c in assemble._ordered(iter(parts), "seq", ["seq", "v"])] == [[2, 3, 5], [0.2, 0.3, 0.5]]
