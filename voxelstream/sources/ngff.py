"""Frames from image folders with NGFF metadata (Zarr version 3): one field of view, or a plate of wells.

Spark lists and reads the chunk files, wherever its file systems reach; a chunk's place in the image follows from its
path and the array's metadata. Chunks are decoded in Arrow batches. Plain, gzip and zstd codecs are known; others need
a library that is not part of this one.
"""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "zarr.json"
FRAMES = "position string, t long, c long, z long, y0 long, x0 long, ny long, nx long, pixels array<double>"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _document(spark: SparkSession, path: str) -> dict[str, Any]:
    """The metadata of one group or array; a small text."""
    return json.loads(spark.read.text(f"{path}/{DOCUMENT}", wholetext=True).first()[0])


def _image(attributes: dict[str, Any]) -> dict[str, Any]:
    return (attributes.get("ome") or attributes).get("multiscales", [{}])[0]


def positions(spark: SparkSession, path: str) -> list[str]:
    """Keys of the fields of view: '0' for a single one, else row/column/field of a plate."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    attributes = _document(spark, path).get("attributes", {})
    if _image(attributes):
        return ["0"]
    plate = (attributes.get("ome") or attributes).get("plate", {})
    found = []
    for well in plate.get("wells", []):
        own = _document(spark, f"{path}/{well['path']}").get("attributes", {})
        fields = (own.get("ome") or own).get("well", {}).get("images", [])
        found += [f"{well['path']}/{field['path']}" for field in fields]
    if not found:
        raise ValueError(f"{path} holds no positions")
    return found


def decoder(array: dict[str, Any]):
    """bytes of a chunk -> its values."""
    order, unpack = "<", []
    for codec in array.get("codecs", []):
        kind, settings = codec["name"], codec.get("configuration", {})
        if kind == "bytes":
            order = ">" if settings.get("endian") == "big" else "<"
        elif kind in ("gzip", "zlib", "zstd", "crc32c"):
            unpack.append(kind)
        else:
            raise ValueError(f"codec {kind!r} needs a library that is not part of this one")
    dtype = np.dtype(array["data_type"]).newbyteorder(order)

    def decode(data: bytes) -> np.ndarray:
        for kind in reversed(unpack):
            if kind == "gzip":
                data = gzip.decompress(data)
            elif kind == "zlib":
                data = zlib.decompress(data)
            elif kind == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            else:
                data = data[:-4]
        return np.frombuffer(data, dtype)

    return decode


def scale(spark: SparkSession, path: str, position: str = "0") -> tuple[float, ...]:
    """The scale of the full-size image along t, c, z, y, x; ones where it is not said."""
    base = path if position == "0" else f"{path}/{position}"
    level = _image(_document(spark, base).get("attributes", {})).get("datasets", [{}])[0]
    steps = [s["scale"] for s in level.get("coordinateTransformations", []) if s.get("type") == "scale"]
    return tuple(float(x) for x in (steps[0] if steps else [1.0] * 5))


def read(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """Tiles of frames of the full-size image: where each begins and its size, and its pixels row by row.

    All positions of a plate are assumed to share shape, type and chunks. Chunks that were never written are absent:
    readers take them for zero.
    """
    keys = positions(spark, path)
    if position is not None and position not in keys:
        raise KeyError(f"position {position!r} is not in {path}")
    first = path if keys == ["0"] else f"{path}/{keys[0]}"
    level = _image(_document(spark, first).get("attributes", {}))["datasets"][0]["path"]
    array = _document(spark, f"{first}/{level}")
    shape, chunk = array["shape"], array["chunk_grid"]["configuration"]["chunk_shape"]
    if len(shape) != 5:
        raise ValueError(f"{path}: axes t, c, z, y, x are wanted, not {len(shape)} axes")
    separator = array.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    decode, size = decoder(array), math.prod(chunk)
    tail = rf"/{level}/c{separator}" + separator.join([r"(\d+)"] * 5) + "$"
    wanted = keys if position is None else [position]
    folders = [path if k == "0" else f"{path}/{k}" for k in wanted]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{f}/{level}" for f in folders])
    name = F.lit("0") if keys == ["0"] else F.regexp_extract(F.regexp_replace("path", tail, ""), r"([^/]+/[^/]+/[^/]+)$", 1)
    at = [F.regexp_extract("path", tail, k + 1).cast("int").alias(f"i{k}") for k in range(5)]
    chunks = files.where(F.col("path").rlike(tail)).select(name.alias("position"), *at, "content")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = [row[f"i{k}"] * chunk[k] for k in range(5)]
                values = decode(row["content"])[:size].reshape(chunk)
                inside = [min(n, total - s) for n, total, s in zip(chunk, shape, start, strict=True)]
                values = values[tuple(slice(n) for n in inside)].astype(np.float64)
                places = [(t, c, z) for t in range(inside[0]) for c in range(inside[1]) for z in range(inside[2])]
                columns = [
                    pa.array([row["position"]] * len(places), pa.string()),
                    *(pa.array([start[k] + p[k] for p in places], pa.int64()) for k in range(3)),
                    *(pa.array([n] * len(places), pa.int64()) for n in (start[3], start[4], inside[3], inside[4])),
                    pa.array([values[p].ravel() for p in places], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FRAMES.split(", ")])

    return chunks.mapInArrow(tiles, FRAMES)
