"""Volumes in tiles against the whole-volume kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelstream.functions import kernels
from voxelstream.operators import tiles
from voxelstream.plans.config import checked


def cut(spark, volumes, tile):
    """Tiles of {key: array}, in no order."""
    rows = []
    for key, v in volumes.items():
        for z in range(0, v.shape[0], tile[0]):
            for y in range(0, v.shape[1], tile[1]):
                for x in range(0, v.shape[2], tile[2]):
                    part = v[z : z + tile[0], y : y + tile[1], x : x + tile[2]]
                    rows.append((key, z, y, x, *part.shape, [float(a) for a in part.ravel()]))
    return spark.createDataFrame(rows[::-1], f"key long, {tiles.TILE}").repartition(3)


def whole(df, shape):
    out = {}
    for r in df.collect():
        v = out.setdefault(r["key"], np.full(shape, np.nan))
        v[r["z0"] : r["z0"] + r["nz"], r["y0"] : r["y0"] + r["ny"], r["x0"] : r["x0"] + r["nx"]] = np.reshape(r["voxels"], (r["nz"], r["ny"], r["nx"]))
    return out


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(3)
    ref = kernels.gaussian_blur(rng.random((7, 11, 13)), 1.0)
    return {1: ref, 2: np.roll(ref, (1, -2, 3), (0, 1, 2)), 3: rng.random((7, 11, 13)), 4: np.full((7, 11, 13), 2.0)}


PAIRS = [(10, 1, 1), (20, 1, 2), (30, 1, 3), (40, 3, 2), (50, 1, 4)]


@pytest.mark.parametrize("normalize", ["none", "magnitude"])
@pytest.mark.parametrize("block", [tiles.BLOCK, 16])
def test_shifts_of_padded_odd_shapes(spark, volumes, monkeypatch, normalize, block):
    """Shapes that are padded by reflection (7, 11 and 13 to 8, 12 and 15), and spectra in one block or in many."""
    monkeypatch.setattr(tiles, "BLOCK", block)
    pairs = spark.createDataFrame(PAIRS[:4], "pair long, reference long, moving long")
    for maximum in (1.0, 0.6):
        got = tiles.shifts(cut(spark, volumes, (3, 4, 6)), pairs, "key", (7, 11, 13), maximum, normalize).collect()
        assert {r["pair"]: (r["dz"], r["dy"], r["dx"]) for r in got} == {p: kernels.correlation_shift(volumes[a], volumes[b], maximum, normalize) for p, a, b in PAIRS[:4]}


def test_surface(spark, volumes):
    pairs = spark.createDataFrame(PAIRS[1:2], "pair long, reference long, moving long")
    got = tiles.surfaces(cut(spark, volumes, (4, 11, 5)), pairs, "key", (7, 11, 13)).toPandas()
    want = kernels.correlation(volumes[1], volumes[2])
    assert len(got) == want.shape[0]
    assert (got.greatest.max(), got.least.min(), got.total.sum()) == pytest.approx((want.max(), want.min(), want.sum()))


@pytest.mark.parametrize(("tile", "sigma"), [((2, 3, 4), 1.7), ((7, 11, 13), 0.8), ((1, 1, 13), 5.0), ((2, 3, 4), 0.0)])
def test_blur_reaches_over_tiles(spark, volumes, tile, sigma):
    got = whole(tiles.blurred(cut(spark, volumes, tile), "key", (7, 11, 13), tile, sigma), (7, 11, 13))
    for key, v in volumes.items():
        assert np.allclose(got[key], kernels.gaussian_blur(v, sigma), atol=1e-12)


def test_masks_and_centers(spark, volumes):
    for component in (0, 1):
        mask = tiles.masks(cut(spark, volumes, (3, 4, 6)), "key", (7, 11, 13), (3, 4, 6), 1.2, component)
        got, centers = whole(mask, (7, 11, 13)), {r["key"]: (r["c_z"], r["c_y"], r["c_x"]) for r in tiles.mask_centers(mask, "key").collect()}
        for key, v in volumes.items():
            want = kernels.binary_mask(v, 1.2, component)
            assert (got[key] == want).all() and centers[key] == pytest.approx(tuple(kernels.center_of_mass(want)))


@pytest.mark.parametrize("method", ["pcc", "multiotsu_pcc", "multiotsu_center_of_mass", "roi_center_pcc", "intensity_center_of_mass"])
def test_settings_choose_the_method(spark, volumes, method):
    """Every method by tiles as by whole volumes, with the section of settings that it reads."""
    from voxelstream.operators import register

    tracking = checked("dynatrack", {"input_channel": "a", "tracking_channel": "a", "tracking_method": method, "segmentation": {"otsu_sigma": 1.0, "otsu_component": 1}, "roi_center": {"blob_sigma": 2.0, "blur_sigma": 0.7, "background_percentile": 40}})
    pairs = spark.createDataFrame(PAIRS[:4], "pair long, reference long, moving long")
    got = {r["pair"]: (r["dz"], r["dy"], r["dx"]) for r in tiles.settings_shifts(cut(spark, volumes, (3, 6, 7)), pairs, "key", (7, 11, 13), (3, 6, 7), tracking).collect()}
    rows = spark.createDataFrame([(p, volumes[a].ravel().tolist(), volumes[b].ravel().tolist()) for p, a, b in PAIRS[:4]], "pair long, ref array<double>, mov array<double>")
    want = rows.select("pair", register.settings_shift(tracking, F.col("ref"), F.col("mov"), (7, 11, 13)).alias("s")).collect()
    for r in want:
        assert got[r["pair"]] == pytest.approx(tuple(r["s"]), abs=1e-9)


def test_a_volume_that_lacks_voxels_is_an_error(spark, volumes):
    some = cut(spark, {1: volumes[1]}, (3, 4, 6)).where("z0 > 0 or y0 > 0")
    with pytest.raises(Exception, match="lacks voxels"):
        tiles.shifts(some, spark.createDataFrame([(1, 1, 1)], "pair long, reference long, moving long"), "key", (7, 11, 13)).collect()


@pytest.mark.parametrize(("window", "overlap"), [((7, 11, 13), (0, 0, 0)), ((3, 5, 4), (1, 2, 0)), ((20, 4, 6), (0, 3, 3))])
def test_windows_give_back_what_is_made_voxel_by_voxel(spark, volumes, window, overlap):
    made = tiles.windowed(cut(spark, volumes, (3, 4, 6)), "key", (7, 11, 13), (3, 4, 6), window, overlap, lambda w: {"same": w, "more": w * w - 1})
    for channel, f in (("same", lambda v: v), ("more", lambda v: v * v - 1)):
        got = whole(made.where(F.col("channel") == channel), (7, 11, 13))
        for key, v in volumes.items():
            assert np.allclose(got[key], f(v), atol=1e-12)


def test_windows_show_no_seams(spark, volumes):
    """A model with a reach of one voxel: inside overlaps of more than two it gives nearly what the whole volume gives."""
    v = volumes[1]

    def smooth(w):
        return {"soft": kernels.gaussian_blur(w, 0.3)}

    got = whole(tiles.windowed(cut(spark, {1: v}, (7, 4, 6)), "key", (7, 11, 13), (7, 4, 6), (7, 8, 8), (0, 6, 6), smooth), (7, 11, 13))[1]
    assert np.abs(got - smooth(v)["soft"]).max() < 0.02 * np.ptp(v)


def test_windows_that_cannot_be(spark, volumes):
    assert tiles.window_starts(10, 4, 1) == [0, 3, 6] and tiles.window_starts(3, 8, 2) == [0] and tiles.window_starts(9, 4, 1) == [0, 3, 5]
    with pytest.raises(ValueError, match="overlap"):
        tiles.window_starts(10, 4, 4)
    with pytest.raises(Exception, match="has the shape"):
        tiles.windowed(cut(spark, {1: volumes[1]}, (7, 11, 13)), "key", (7, 11, 13), (7, 11, 13), (7, 11, 13), (0, 0, 0), lambda w: {"a": w[1:]}).collect()


@pytest.mark.parametrize("block", [tiles.BLOCK, 16])
def test_inverse_filter(spark, volumes, monkeypatch, block):
    """A given transfer function is undone as by spectra of whole volumes; without regularisation, entirely."""
    monkeypatch.setattr(tiles, "BLOCK", block)
    shape = (7, 11, 13)

    def transfer(z, y, x):
        return (0.2 + np.exp(-3 * (z**2 + 2 * y**2 + x**2))) * np.exp(-2j * np.pi * (z + 2 * y))

    freq = [np.fft.fftfreq(7)[:, None, None], np.fft.fftfreq(11)[None, :, None], np.fft.rfftfreq(13)[None, None, :]]
    h = transfer(*freq)
    for regularization in (0.05, 0.0):
        got = whole(tiles.inverse_filtered(cut(spark, volumes, (3, 4, 6)), "key", shape, transfer, regularization), shape)
        for key, v in volumes.items():
            assert np.allclose(got[key], np.fft.irfftn(np.fft.rfftn(v) * np.conj(h) / (np.abs(h) ** 2 + regularization), s=shape, axes=(0, 1, 2)), atol=1e-10)
    blurred = {k: np.fft.irfftn(np.fft.rfftn(v) * h, s=shape, axes=(0, 1, 2)) for k, v in volumes.items()}
    back = whole(tiles.inverse_filtered(cut(spark, blurred, (3, 4, 6)), "key", shape, transfer, 0.0), shape)
    assert all(np.allclose(back[k], v, atol=1e-9) for k, v in volumes.items())


@pytest.mark.parametrize(("angle", "ratio", "average", "overhang"), [(30.0, 0.4, 1, True), (30.0, 0.4, 3, True), (36.0, 1.0, 2, False), (60.0, 2.5, 1, False)])
def test_deskewed_tiles_equal_whole_volumes(spark, volumes, angle, ratio, average, overhang):
    tile, out_tile = (3, 4, 5), (2, 3, 6)
    shape = tiles.deskewed_shape((7, 11, 13), angle, ratio, average, overhang)
    made = tiles.deskewed(cut(spark, volumes, tile), "key", (7, 11, 13), out_tile, angle, ratio, average, overhang)
    assert len({(r["key"], r["z0"], r["y0"], r["x0"]) for r in made.collect()}) == made.count()
    for key, found in whole(made, shape).items():
        expected = kernels.deskew(volumes[key], angle, ratio, average, overhang)
        assert found.shape == expected.shape and np.allclose(found, expected, atol=1e-12)
    assert all(r["nz"] <= 2 and r["ny"] <= 3 and r["nx"] <= 6 for r in made.collect())


def test_a_sheared_block_comes_back(spark):
    """A block that stands upright, seen through a light sheet at 45 degrees, stands upright again, at its place."""
    scans, tilts = np.meshgrid(np.arange(40), np.arange(20), indexing="ij")
    angle = np.deg2rad(45)
    height, along = tilts * np.sin(angle), scans + tilts * np.cos(angle)
    seen = ((height >= 4) & (height <= 9) & (along >= 20) & (along <= 30)).astype(float)[:, :, None] * np.arange(1.0, 4.0)
    made = whole(tiles.deskewed(cut(spark, {7: seen}, (16, 7, 2)), "key", seen.shape, (5, 16, 2), 45.0, 1.0), tiles.deskewed_shape(seen.shape, 45.0, 1.0))[7]
    assert np.allclose(made[5:9, 22:29], np.arange(1.0, 4.0)) and not made[:3].any() and not made[11:].any() and not made[:, :18].any() and not made[:, 33:].any()


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_many_small_groups_go_through_a_task_in_one_stream(spark):
    """Spark's own calls for each group took most of the time of small volumes."""
    rng = np.random.default_rng(8)
    volumes = {k: rng.normal(size=(4, 4, 4)) for k in range(300)}
    rows = [(k, z, y, x, float(v[z, y, x])) for k, v in volumes.items() for z, y, x in np.ndindex(v.shape)]
    cut = tiles.from_voxels(spark.createDataFrame(rows, "id long, z long, y long, x long, v double"), "id", (4, 4, 4), (3, 4, 4))
    pairs = spark.createDataFrame([(k, k // 5 * 5, k) for k in volumes], "pair long, reference long, moving long")
    found = tiles.shifts(cut, pairs, "id", (4, 4, 4))
    assert "FlatMapGroupsInArrow" not in _plan(found)
    got = {r.pair: (r.dz, r.dy, r.dx) for r in found.collect()}
    assert got == {k: tuple(map(float, kernels.correlation_shift(volumes[k // 5 * 5], v))) for k, v in volumes.items()}


def test_the_blob_that_all_pairs_share_is_not_joined(spark):
    """Its spectrum is a product of three lines: as tiles it was one key of a join for all pairs."""
    rng, shape = np.random.default_rng(9), (5, 6, 7)
    volumes = {k: rng.random(shape) for k in range(4)}
    rows = [(k, z, y, x, float(v[z, y, x])) for k, v in volumes.items() for z, y, x in np.ndindex(shape)]
    cut = tiles.from_voxels(spark.createDataFrame(rows, "id long, z long, y long, x long, v double"), "id", shape, (3, 4, 4))
    pairs = spark.createDataFrame([(k, 0, k) for k in volumes], "pair long, reference long, moving long")
    for block in (tiles.BLOCK, 5 * 4 * 16 * 2):  # one block, and several of two rows each
        tiles.BLOCK, before = block, tiles.BLOCK
        try:
            found = tiles.surfaces(cut, pairs, "id", shape, profiles=tiles.blob_profiles(shape, 3.0))
            got = {r["pair"]: r["greatest"] for r in found.groupBy("pair").agg({"greatest": "max"}).withColumnRenamed("max(greatest)", "greatest").collect()}
        finally:
            tiles.BLOCK = before
        for k, v in volumes.items():
            assert abs(got[k] - kernels.correlation(kernels.centered_blob(shape, 3.0), v).max()) < 1e-9
    assert _plan(found.select("pair")).split("== Physical Plan ==")[1].count("Join") == 1
