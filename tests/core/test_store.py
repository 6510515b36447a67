"""Image stores: both versions of the metadata, shards, pruned reads, writes that are whole or nothing."""

import gzip
import json
import zlib
from itertools import product

import numpy as np
import pytest
from voxelstream.sources import frames, ngff, sinks, store

SHAPE, CHUNK, SHARD = (3, 2, 5, 6, 7), (1, 1, 2, 4, 4), (2, 1, 4, 8, 8)
KEYS = ("A/1/0", "A/1/1", "B/12/0")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    return {key: rng.integers(0, 65536, SHAPE).astype(np.uint16) for key in KEYS}


def planes(spark, images, parts=3):
    rows = [(key, t, c, z, 0, 0, *v.shape[3:], [float(a) for a in v[t, c, z].ravel()]) for key, v in images.items() for t, c, z in product(*map(range, v.shape[:3]))]
    return spark.createDataFrame(rows[::-1], ngff.FRAMES).repartition(parts)


def assembled(rows, shape=SHAPE):
    out = {}
    for r in rows:
        v = out.setdefault(r["position"], np.zeros(shape))
        v[r["t"], r["c"], r["z"], r["y0"] : r["y0"] + r["ny"], r["x0"] : r["x0"] + r["nx"]] += np.reshape(r["pixels"], (r["ny"], r["nx"]))
    return out


@pytest.fixture(scope="module")
def plate(spark, images, tmp_path_factory):
    path = tmp_path_factory.mktemp("stores") / "plate.ome.zarr"
    store.write(planes(spark, images), str(path), SHAPE, "uint16", CHUNK, SHARD, scale=(1, 1, 2.5, 0.5, 0.5), channels=["BF", "GFP"], summary={"name": "run"})
    return path


def test_plate_comes_back(spark, images, plate):
    found = assembled(store.read(spark, str(plate), 3).collect())
    assert list(store.positions(str(plate))) == list(KEYS) and set(found) == set(KEYS)
    assert all((found[k] == images[k]).all() for k in KEYS)
    assert ngff.scale(spark, str(plate), "A/1/0") == (1.0, 1.0, 2.5, 0.5, 0.5)
    document = json.loads((plate / "A/1/0/zarr.json").read_text())["attributes"]
    assert [c["label"] for c in document["ome"]["omero"]["channels"]] == ["BF", "GFP"] and document["summary"] == {"name": "run"}
    assert not [p for p in plate.rglob("*") if p.is_file() and p.name != "zarr.json" and not p.name.isdigit()]


def test_shards_hold_chunks_and_a_checked_index(plate, images):
    """The file format by hand: offsets and lengths at the end, then their CRC-32C."""
    import zstandard

    data = (plate / "A/1/1/0/c/1/0/1/0/0").read_bytes()
    inside = [s // c for s, c in zip(SHARD, CHUNK, strict=True)]
    index = np.frombuffer(data[-(16 * int(np.prod(inside)) + 4) : -4], "<u8").reshape(*inside, 2)
    assert store.crc32c(b"123456789") == 0xE3069283
    assert store.crc32c(index.tobytes()) == int.from_bytes(data[-4:], "little")
    offset, size = index[0, 0, 0, 1, 1].tolist()
    chunk = np.frombuffer(zstandard.decompress(data[offset : offset + size]), "<u2").reshape(CHUNK)
    assert (chunk[0, 0, 0, :2, :3] == images["A/1/1"][2, 0, 4, 4:, 4:]).all() and not chunk[0, 0, 1].any()
    assert (index[1] == store.ABSENT).all()  # beyond the last timepoint


@pytest.mark.parametrize("where", ["position = 'B/12/0' and t = 2 and c = 1", "position = 'B/12/0' and t >= 2 and c > 0 and z < 9", "t in (2, 7) and c = 1 and position in ('B/12/0', 'none')"])
def test_filters_open_only_their_files(spark, images, plate, where, tmp_path):
    """All other files are spoilt in a copy, so that opening one fails."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(plate, copy)
    for file in copy.rglob("*"):
        if file.is_file() and file.name != "zarr.json" and "B/12/0/0/c/1/1/" not in str(file):
            file.write_bytes(b"spoilt, and long enough" * 40)
    rows = store.read(spark, str(copy)).where(where).collect()
    assert (assembled(rows)["B/12/0"][2, 1] == images["B/12/0"][2, 1]).all()
    assert {(r["position"], r["t"], r["c"]) for r in rows} == {("B/12/0", 2, 1)}
    with pytest.raises(Exception, match="damaged"):
        store.read(spark, str(copy)).collect()


def test_filters_deal_only_their_files(plate):
    reader = store.ImageStoreReader(str(plate), 1)
    assert len(reader.partitions()) == 3 * 2 * 2 * 2
    from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan

    pushed = [EqualTo(("position",), "A/1/0"), LessThan(("z",), 4), EqualTo(("t",), 1), IsNotNull(("t",))]
    assert list(reader.pushFilters(pushed)) == pushed and len(reader.partitions()) == 2
    lost = store.ImageStoreReader(str(plate), 1)
    list(lost.pushFilters([EqualTo(("c",), None)]))
    assert lost.partitions() == []


def test_damaged_chunks_of_unwanted_planes_are_not_read(spark, images, plate, tmp_path):
    """Chunks of a shard that no wanted plane needs aren't unpacked."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(plate, copy)
    file = copy / "A/1/0/0/c/0/0/0/0/0"
    data = bytearray(file.read_bytes())
    inside = [s // c for s, c in zip(SHARD, CHUNK, strict=True)]
    index = np.frombuffer(bytes(data[-(16 * int(np.prod(inside)) + 4) : -4]), "<u8").reshape(*inside, 2)
    for at in np.ndindex(*inside):
        if at[2] == 1:
            offset, size = index[at].tolist()
            data[offset : offset + size] = b"\0" * size
    file.write_bytes(bytes(data))
    rows = store.read(spark, str(copy)).where("position = 'A/1/0' and t < 2 and c = 0 and z < 2").collect()
    assert (assembled(rows)["A/1/0"][:2, 0, :2] == images["A/1/0"][:2, 0, :2]).all()
    with pytest.raises(Exception, match="(?i)zstd|decompress"):
        store.read(spark, str(copy)).where("position = 'A/1/0'").collect()


@pytest.mark.parametrize("codec", [None, "gzip"])
@pytest.mark.parametrize("data_type", ["float32", "int16"])
def test_single_field_in_pieces(spark, tmp_path, codec, data_type):
    """Parts of planes that lie across chunks; a plane that is absent reads as zero inside its chunk, else not at all."""
    values = np.random.default_rng(1).integers(-900, 900, (1, 1, 6, 6, 7)).astype(np.float64)
    rows = [("0", 0, 0, z, y, 0, min(5, 6 - y), 7, values[0, 0, z, y : y + 5].ravel().tolist()) for z in (0, 1, 2, 3) if z != 1 for y in (0, 5)]
    path = str(tmp_path / "field.zarr")
    store.write(spark.createDataFrame(rows, ngff.FRAMES), path, values.shape, data_type, (1, 1, 2, 4, 4), codec=codec)
    found = store.read(spark, path).collect()
    values[:, :, [1, 4, 5]] = 0
    assert (assembled(found, values.shape)["0"] == values).all() and {r["z"] for r in found} == {0, 1, 2, 3}


def test_extra_columns_are_left_out(spark, tmp_path, images):
    from pyspark.sql import functions as F

    path = str(tmp_path / "s")
    store.write(planes(spark, {"0": images["A/1/0"]}).withColumn("file", F.lit(3)).withColumn("layout", F.lit("x")), path, SHAPE, "uint16")
    assert (assembled(store.read(spark, path).collect())["0"] == images["A/1/0"]).all()


def test_empty(spark, tmp_path):
    path = str(tmp_path / "empty")
    store.write(spark.createDataFrame([], ngff.FRAMES), path, SHAPE, "uint16")
    assert store.read(spark, path).count() == 0 and list(store.positions(path)) == ["0"]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: r | {"t": 3}, "outside"),
        (lambda r: r | {"z": -1}, "outside"),
        (lambda r: r | {"pixels": [70000.0] * 42}, "do not fit"),
        (lambda r: r | {"pixels": [0.5] * 42}, "do not fit"),
        (lambda r: r | {"pixels": [None] + [1.0] * 41}, "must have"),
        (lambda r: r | {"position": None}, "must have"),
        (lambda r: r | {"pixels": None}, "must have"),
        (lambda r: r | {"z": 1}, "twice"),
        (lambda r: r | {"position": "well 1"}, "row/column/field"),
    ],
)
def test_failed_writes_leave_nothing(spark, images, tmp_path, change, message):
    rows = [r.asDict() for r in planes(spark, {"A/1/0": images["A/1/0"]}).collect()]
    last = max(range(len(rows)), key=lambda k: (rows[k]["t"], rows[k]["c"], rows[k]["z"]))
    rows[last] = change(rows[last])
    bad = spark.createDataFrame([tuple(r.values()) for r in rows], ngff.FRAMES)
    with pytest.raises(Exception, match=message):
        store.write(bad, str(tmp_path / "bad"), SHAPE, "uint16", CHUNK, SHARD)
    assert not list(tmp_path.rglob("*"))


def test_never_over_what_is_there(spark, images, plate):
    before = sorted((str(p), p.stat().st_mtime_ns) for p in plate.rglob("*"))
    with pytest.raises(Exception, match="(?i)exists|plate.ome.zarr"):
        store.write(planes(spark, images), str(plate), SHAPE, "uint16", CHUNK, SHARD)
    assert sorted((str(p), p.stat().st_mtime_ns) for p in plate.rglob("*")) == before


def test_arguments(spark, images, tmp_path):
    rows = planes(spark, {"0": images["A/1/0"]})
    for bad in ({"codec": "blosc"}, {"chunk": (1, 1, 2, 4, 4), "shard": (1, 1, 3, 8, 8)}, {"shape": (1, 2, 3)}):
        with pytest.raises(ValueError):
            store.write(rows, str(tmp_path / "x"), **({"shape": SHAPE, "data_type": "uint16"} | bad))
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(("packing", "order", "separator"), [("zlib", "C", "/"), ("gzip", "F", "."), (None, "C", ".")])
def test_older_metadata(spark, tmp_path, packing, order, separator):
    """Zarr 2 arrays, big-endian, in either order of elements; a chunk that was never written is absent."""
    values = np.random.default_rng(2).integers(0, 60000, SHAPE).astype(">u2")
    image = {"multiscales": [{"version": "0.4", "axes": [{"name": a} for a in "tczyx"], "datasets": [{"path": "0"}]}]}
    array = {"zarr_format": 2, "shape": SHAPE, "chunks": CHUNK, "dtype": ">u2", "order": order, "fill_value": 0, "filters": None, "compressor": {"id": packing} if packing else None, "dimension_separator": separator}
    (tmp_path / "old/0").mkdir(parents=True)
    (tmp_path / "old/.zattrs").write_text(json.dumps(image))
    (tmp_path / "old/0/.zarray").write_text(json.dumps(array))
    pack = {"zlib": zlib.compress, "gzip": gzip.compress, None: bytes}[packing]
    for at in product(*(range(-(-n // c)) for n, c in zip(SHAPE, CHUNK, strict=True))):
        if at[:2] == (2, 1):
            continue
        full = np.zeros(CHUNK, ">u2")
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, CHUNK, strict=True))]
        full[tuple(slice(n) for n in part.shape)] = part
        file = tmp_path / "old/0" / separator.join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(pack(full.tobytes(order)))
    rows = store.read(spark, str(tmp_path / "old")).collect()
    expected = values.astype(float)
    expected[2, 1] = 0
    assert (assembled(rows)["0"] == expected).all() and (2, 1) not in {(r["t"], r["c"]) for r in rows}


def test_unknown_packing_is_an_error(spark, tmp_path):
    (tmp_path / "b/0").mkdir(parents=True)
    (tmp_path / "b/.zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "0"}]}]}))
    (tmp_path / "b/0/.zarray").write_text(json.dumps({"shape": SHAPE, "chunks": CHUNK, "dtype": "<u2", "compressor": {"id": "blosc"}}))
    with pytest.raises(Exception, match="blosc"):
        store.read(spark, str(tmp_path / "b")).collect()


def test_requests_open_only_their_folders(spark, tmp_path):
    """Requests that are known at run time only; files of the timepoint that none of them names are spoilt."""
    places = list(product(range(2), range(3), range(2)))
    rows = [("a", p, t, c, z, 1, 2, "uint16", [p, 100 * t + 10 * c + z]) for p, t, c in places for z in range(3)]
    path = str(tmp_path / "frames")
    sinks.write_frames(spark.createDataFrame(rows, frames.FRAMES).repartition(1), path, ["BF", "GFP"])
    asked = [("a", 1, 5, 3, 7), ("a", 0, -3, 0, 8), ("a", 0, -3, 0, 9), ("b", 0, 0, 0, 1), ("a", None, 0, 0, 2), ("a", 1, None, 0, 3)]
    spark.createDataFrame(asked, "acq string, p int, t int, c int, id int").write.parquet(str(tmp_path / "requests"))
    requests = spark.read.parquet(str(tmp_path / "requests"))
    for file in (tmp_path / "frames").rglob("*.parquet"):
        if "t=1" in str(file):
            file.write_bytes(b"spoilt")
    found = frames.requested(requests, frames.read_frames(spark, path), {"t": 3, "c": 2})
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    got = sorted((r["id"], r["p"], r["t"], r["c"], r["z"], *r["pixels"]) for r in found.collect())
    assert got == sorted([(7, 1, 2, 1, z, 1, 210 + z) for z in range(3)] + [(k, 0, 0, 0, z, 0, z) for k in (8, 9) for z in range(3)])
    with pytest.raises(Exception, match="spoilt|Parquet|parquet"):
        frames.read_frames(spark, path).collect()
    with pytest.raises(ValueError, match="pixels"):
        frames.requested(requests.withColumnRenamed("id", "pixels"), frames.read_frames(spark, path), {"t": 3, "c": 2})
