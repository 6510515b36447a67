import gzip
import json
from itertools import product

import numpy as np
import pytest
import zstandard
from voxelstream.sources import ngff

SHAPE, CHUNK = (2, 2, 3, 5, 4), (1, 1, 2, 3, 4)
SCALE = [1.0, 1.0, 2.5, 0.5, 0.5]


def write_field(folder, values, codec):
    folder.mkdir(parents=True)
    image = {"axes": [{"name": a} for a in "tczyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": SCALE}]}]}
    (folder / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"multiscales": [image]}}}))
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
    array = {"zarr_format": 3, "node_type": "array", "shape": SHAPE, "data_type": "uint16", "codecs": codecs, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": CHUNK}}}
    (folder / "0").mkdir()
    (folder / "0/zarr.json").write_text(json.dumps(array))
    pack = {"gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress, None: bytes}.get(codec, bytes)
    for at in product(*(range(-(-n // c)) for n, c in zip(SHAPE, CHUNK, strict=True))):
        full = np.zeros(CHUNK, "<u2")
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, CHUNK, strict=True))]
        full[tuple(slice(n) for n in part.shape)] = part
        path = folder / "0/c" / "/".join(map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(pack(full.tobytes()))


def assembled(rows):
    out = np.zeros(SHAPE)
    for r in rows:
        out[r["t"], r["c"], r["z"], r["y0"] : r["y0"] + r["ny"], r["x0"] : r["x0"] + r["nx"]] = np.reshape(r["pixels"], (r["ny"], r["nx"]))
    return out


@pytest.mark.parametrize("codec", ["zstd", "gzip", None])
def test_one_field(spark, tmp_path, codec):
    values = np.random.default_rng(0).integers(0, 65535, SHAPE).astype(np.uint16)
    path = str(tmp_path / "image.ome.zarr")
    write_field(tmp_path / "image.ome.zarr", values, codec)
    rows = ngff.read(spark, path).collect()
    assert ngff.positions(spark, path) == ["0"] and {r["position"] for r in rows} == {"0"}
    assert (assembled(rows) == values).all() and ngff.scale(spark, path) == tuple(SCALE)


def test_plate(spark, tmp_path):
    plate = tmp_path / "plate.zarr"
    fields = {f"A/{c}/{f}": np.full(SHAPE, 10 * c + f, np.uint16) for c in (1, 2) for f in (0, 1)}
    for key, values in fields.items():
        write_field(plate / key, values, "zstd")
    for c in (1, 2):
        (plate / f"A/{c}/zarr.json").write_text(json.dumps({"attributes": {"ome": {"well": {"images": [{"path": "0"}, {"path": "1"}]}}}}))
    (plate / "zarr.json").write_text(json.dumps({"attributes": {"ome": {"plate": {"wells": [{"path": "A/1"}, {"path": "A/2"}]}}}}))
    assert ngff.positions(spark, str(plate)) == list(fields)
    rows = ngff.read(spark, str(plate)).collect()
    for key, values in fields.items():
        assert (assembled([r for r in rows if r["position"] == key]) == values).all()
    only = ngff.read(spark, str(plate), "A/2/1").select("position").distinct().collect()
    assert [r[0] for r in only] == ["A/2/1"]
    with pytest.raises(KeyError):
        ngff.read(spark, str(plate), "B/1/0")


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ngff.positions(spark, str(tmp_path / "none"))
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "zarr.json").write_text(json.dumps({"attributes": {"ome": {"plate": {"wells": []}}}}))
    with pytest.raises(ValueError, match="no positions"):
        ngff.positions(spark, str(empty))
    write_field(tmp_path / "blosc", np.zeros(SHAPE, np.uint16), "blosc")
    with pytest.raises(ValueError, match="blosc"):
        ngff.read(spark, str(tmp_path / "blosc"))
