"""Image stores with NGFF metadata as a data source: ``spark.read.format("image_store")`` and a writer of shards.

Both versions of the metadata are read: Zarr 3 (plain or sharded) and Zarr 2. A row is a part of a plane, as in
``ngff.FRAMES``. Filters on position, t, c and z leave out whole files, then chunks of a shard, then planes; what is left
out is not opened. Chunks that were never written are absent: readers take them for zero.

The driver reads the metadata of groups and arrays and deals ranges of files out; it lists no folder. Files are reached
through Arrow's file systems, so paths may be local or URIs that those know (``s3://``, ``hdfs://``, ...). A task holds
one chunk at a time, when it reads and when it writes.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .ngff import FRAMES, decoder

FORMAT = "image_store"
NAMES = [f.split()[0] for f in FRAMES.split(", ")]
AXES = ("t", "c", "z", "y", "x")
SENT = 16 << 20  # bytes of pixels in a batch of rows
FILES_PER_TASK = 8

#: The offset and length of a chunk that a shard lacks, and the polynomial of CRC-32C (reflected).
ABSENT = 2**64 - 1
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        table.append(n)
    return table


CRC_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    """The checksum of a shard's index, which has 16 bytes for each chunk."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = CRC_TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


# --- files and metadata ----------------------------------------------------------------------------------


def _located(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return fs.LocalFileSystem(), os.path.abspath(local)
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside.rstrip("/")


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def _json(system: fs.FileSystem, path: str) -> dict[str, Any] | None:
    try:
        with system.open_input_stream(path) as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def _attributes(system: fs.FileSystem, folder: str) -> dict[str, Any]:
    """What a group says of itself, in either version."""
    document = _json(system, f"{folder}/zarr.json")
    own = document.get("attributes", {}) if document is not None else _json(system, f"{folder}/.zattrs") or {}
    return own.get("ome") or own


@dataclass
class Layout:
    """Where the chunks of one array lie, and how they are packed."""

    shape: list[int]
    chunk: list[int]
    file: list[int]  # voxels of a file along each axis: a shard, or one chunk
    prefix: str
    separator: str
    array: dict[str, Any]  # data type and codecs of a chunk
    sharded: bool = False
    index_at_end: bool = True
    index_checked: bool = True
    order: str = "C"

    @property
    def inside(self) -> list[int]:
        return [f // c for f, c in zip(self.file, self.chunk, strict=True)]

    def name(self, at: Iterable[int]) -> str:
        return self.prefix + self.separator.join(map(str, at))


#: Names of packing in version 2 and 3.
PACKING = {"gzip": "gzip", "zlib": "zlib", "zstd": "zstd"}


def _layout_2(document: dict[str, Any]) -> Layout:
    packing = document.get("compressor")
    if document.get("filters"):
        raise ValueError("filters of arrays are not known")
    if packing and packing["id"] not in PACKING:
        raise ValueError(f"codec {packing['id']!r} needs a library that is not part of this one")
    dtype = np.dtype(document["dtype"])
    codecs = [{"name": "bytes", "configuration": {"endian": "big" if dtype.str.startswith(">") else "little"}}]
    codecs += [{"name": PACKING[packing["id"]]}] if packing else []
    array = {"data_type": dtype.newbyteorder("=").name, "codecs": codecs}
    return Layout(document["shape"], document["chunks"], document["chunks"], "", document.get("dimension_separator", "."), array, order=document.get("order", "C"))


def _layout_3(document: dict[str, Any]) -> Layout:
    keys = document.get("chunk_key_encoding", {"name": "default"})
    plain = keys.get("name", "default") == "v2"
    separator = keys.get("configuration", {}).get("separator", "." if plain else "/")
    shape, file, codecs = document["shape"], document["chunk_grid"]["configuration"]["chunk_shape"], document.get("codecs", [])
    out = Layout(shape, file, file, "" if plain else f"c{separator}", separator, {"data_type": document["data_type"], "codecs": codecs})
    if codecs and codecs[0]["name"] == "sharding_indexed":
        if len(codecs) > 1:
            raise ValueError("codecs around shards are not known")
        own = codecs[0]["configuration"]
        names = [c["name"] for c in own.get("index_codecs", [])]
        if names[:1] != ["bytes"] or names[1:] not in ([], ["crc32c"]) or own["index_codecs"][0].get("configuration", {}).get("endian", "little") != "little":
            raise ValueError(f"index codecs {names} of shards are not known")
        out.sharded, out.chunk, out.array = True, own["chunk_shape"], out.array | {"codecs": own["codecs"]}
        out.index_at_end, out.index_checked = own.get("index_location", "end") == "end", names[1:] == ["crc32c"]
        if any(f % c for f, c in zip(file, out.chunk, strict=True)):
            raise ValueError("the chunks of a shard must fill it")
    return out


def _layout(system: fs.FileSystem, folder: str) -> tuple[str, Layout]:
    """The folder of a field's full-size array, and its layout."""
    sets = _attributes(system, folder).get("multiscales", [{}])[0].get("datasets", [])
    if not sets:
        raise ValueError(f"{folder} holds no image")
    path = f"{folder}/{sets[0]['path']}"
    newer = _json(system, f"{path}/zarr.json")
    document = newer if newer is not None else _json(system, f"{path}/.zarray")
    if document is None:
        raise FileNotFoundError(path)
    out = _layout_3(document) if newer is not None else _layout_2(document)
    if len(out.shape) != 5:
        raise ValueError(f"{path}: axes t, c, z, y, x are wanted, not {len(out.shape)} axes")
    decoder(out.array)  # an unknown codec is an error before any task runs
    return path, out


def positions(path: str) -> dict[str, str]:
    """Fields of view and their folders: '0' for a single one, else row/column/field of a plate."""
    system, base = _located(path)
    if not _exists(system, base):
        raise FileNotFoundError(path)
    own = _attributes(system, base)
    if own.get("multiscales"):
        return {"0": base}
    wells = [w["path"] for w in own.get("plate", {}).get("wells", [])]
    with ThreadPoolExecutor(16) as pool:
        fields = list(pool.map(lambda w: _attributes(system, f"{base}/{w}").get("well", {}).get("images", []), wells))
    found = [f"{well}/{f['path']}" for well, images in zip(wells, fields, strict=True) for f in images]
    if not found:
        raise ValueError(f"{path} holds no positions")
    return {key: f"{base}/{key}" for key in found}


# --- reading ---------------------------------------------------------------------------------------------

_COMPARED = {
    EqualTo: lambda a, b: a == b,
    EqualNullSafe: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class Files(InputPartition):
    """The files from ``first`` to below ``last`` of the grid that the wanted files of each axis span."""

    position: str
    path: str
    layout: Layout
    grid: list[list[int]]
    first: int
    last: int


class ImageStoreReader(DataSourceReader):
    def __init__(self, path: str, files_per_task: int):
        self.path, self.files_per_task, self.wanted = path, files_per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what is said of position, t, c and z; Spark checks every filter again on the rows that come."""
        for f in filters:
            if type(f) in _COMPARED and f.attribute[0] in ("position", "t", "c", "z"):
                self.wanted.append((f.attribute[0], type(f), f.value))
            yield f

    def _allows(self, name: str, value) -> bool:
        return all(other is not None and _COMPARED[kind](value, other) for axis, kind, other in self.wanted if axis == name)

    def _parts(self, name: str, n: int, size: int) -> list[int]:
        """The files or chunks along an axis that hold a wanted index."""
        return [i for i in range(-(-n // size)) if any(self._allows(name, k) for k in range(i * size, min((i + 1) * size, n)))]

    def partitions(self) -> list[Files]:
        system, _ = _located(self.path)
        folders = [(key, folder) for key, folder in positions(self.path).items() if self._allows("position", key)]
        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(lambda f: _layout(system, f[1]), folders))
        out = []
        for (key, _), (path, layout) in zip(folders, layouts, strict=True):
            grid = [self._parts(a, n, f) for a, n, f in zip(AXES, layout.shape, layout.file, strict=True)]
            total = math.prod(map(len, grid))
            out += [Files(key, path, layout, grid, k, min(k + self.files_per_task, total)) for k in range(0, total, self.files_per_task)]
        return out

    def _chunks(self, file: pa.NativeFile, layout: Layout, at: list[int]) -> Iterator[tuple[list[int], bytes]]:
        """Where the wanted chunks of a file begin, and their packed bytes."""
        corner = [i * f for i, f in zip(at, layout.file, strict=True)]
        if not layout.sharded:
            yield corner, file.read()
            return
        length = 16 * math.prod(layout.inside) + 4 * layout.index_checked
        data = file.read_at(length, file.size() - length if layout.index_at_end else 0)
        if layout.index_checked and crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("the index of a shard is damaged")
        index = np.frombuffer(data, "<u8", 2 * math.prod(layout.inside)).reshape(*layout.inside, 2)
        for inner in np.ndindex(*layout.inside):
            start = [c + i * n for c, i, n in zip(corner, inner, layout.chunk, strict=True)]
            ends = [min(s + n, total) for s, n, total in zip(start, layout.chunk, layout.shape, strict=True)]
            offset, size = (int(v) for v in index[inner])
            kept = all(any(self._allows(a, k) for k in range(s, e)) for a, s, e in zip(AXES[:3], start, ends, strict=False))
            if offset != ABSENT and kept and all(s < e for s, e in zip(start, ends, strict=True)):
                yield start, file.read_at(size, offset)

    def _planes(self, partition: Files) -> Iterator[tuple]:
        layout = partition.layout
        decode, (system, _) = decoder(layout.array), _located(self.path)
        for k in range(partition.first, partition.last):
            at = [own[i] for own, i in zip(partition.grid, np.unravel_index(k, [len(g) for g in partition.grid]), strict=True)]
            try:
                file = system.open_input_file(f"{partition.path}/{layout.name(at)}")
            except FileNotFoundError:
                continue
            with file:
                for start, data in self._chunks(file, layout, at):
                    values = decode(data)[: math.prod(layout.chunk)].reshape(layout.chunk, order=layout.order)
                    inside = [min(n, total - s) for n, total, s in zip(layout.chunk, layout.shape, start, strict=True)]
                    spans = [[s + i for i in range(n) if self._allows(a, s + i)] for a, s, n in zip(AXES[:3], start, inside, strict=False)]
                    for t, c, z in product(*spans):
                        plane = values[t - start[0], c - start[1], z - start[2], : inside[3], : inside[4]]
                        yield partition.position, t, c, z, *start[3:], *inside[3:], plane.astype(np.float64).ravel()

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._planes(partition):
            rows.append(row)
            held += row[-1].nbytes
            if held > SENT:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


# --- writing ---------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: positions and, for each, the numbers of its files."""

    files: dict[str, np.ndarray] = field(default_factory=dict)


class _Shard:
    """A shard under a name of its own, put in place when it is whole."""

    def __init__(self, system: fs.FileSystem, path: str, layout: Layout):
        self.system, self.path, self.own, self.layout = system, path, f"{path}.{uuid.uuid4().hex}", layout
        system.create_dir(os.path.dirname(path), recursive=True)
        self.file, self.at = system.open_output_stream(self.own, compression=None), 0
        self.index = np.full((*layout.inside, 2), ABSENT, "<u8")

    def add(self, inner: tuple[int, ...], data: bytes) -> None:
        if self.index[inner][0] != ABSENT:
            raise ValueError("rows of a chunk must come together: use store.write")
        self.file.write(data)
        self.index[inner] = self.at, len(data)
        self.at += len(data)

    def close(self) -> None:
        index = self.index.tobytes()
        self.file.write(index + crc32c(index).to_bytes(4, "little"))
        self.file.close()
        self.system.move(self.own, self.path)

    def drop(self) -> None:
        self.file.close()
        if _exists(self.system, self.own):
            self.system.delete_file(self.own)


class ImageStoreWriter(DataSourceArrowWriter):
    """Shards of one chunk after the other. The groups' metadata comes last: without it there is no store."""

    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        own = json.loads(options["layout"])
        self.path, self.options = path, own
        system, base = _located(path)
        if overwrite:
            raise ValueError("stores are never written over")
        if _exists(system, base):
            raise FileExistsError(path)
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
        codecs += [{"name": own["codec"]} | ({"configuration": {"level": 1, "checksum": False} if own["codec"] == "zstd" else {"level": 5}})] if own["codec"] else []
        self.layout = Layout(own["shape"], own["chunk"], own["shard"], "c/", "/", {"data_type": own["data_type"], "codecs": codecs}, True)

    def _pack(self, values: np.ndarray) -> bytes:
        data = values.tobytes()
        if self.options["codec"] == "zstd":
            import zstandard

            return zstandard.ZstdCompressor(level=1).compress(data)
        if self.options["codec"] == "gzip":
            import gzip

            return gzip.compress(data, 5, mtime=0)
        return data

    def _pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows as position, file, chunk in the file, place in the chunk, and plane."""
        lay = self.layout
        for batch in batches:
            pixels = batch.column("pixels")
            for k, row in enumerate(batch.select(NAMES[:-1]).to_pylist()):
                start, size = [row[n] for n in ("t", "c", "z", "y0", "x0")], (row["ny"], row["nx"])
                file = tuple(s // f for s, f in zip(start, lay.file, strict=True))
                inner = tuple(s % f // c for s, f, c in zip(start, lay.file, lay.chunk, strict=True))
                place = [s % c for s, c in zip(start, lay.chunk, strict=True)]
                ends = [*(s + 1 for s in start[:3]), start[3] + size[0], start[4] + size[1]]
                if min(start) < 0 or any(e > n for e, n in zip(ends, lay.shape, strict=True)) or any(p + m > c for p, m, c in zip(place[3:], size, lay.chunk[3:], strict=True)):
                    raise ValueError(f"a tile at {start} of size {size} lies outside the image or over the border of a chunk")
                yield row["position"], file, inner, place, pixels[k].values.to_numpy(zero_copy_only=False).reshape(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _located(self.path)
        lay, dtype = self.layout, np.dtype(self.options["data_type"]).newbyteorder("<")
        counts = [-(-n // f) for n, f in zip(lay.shape, lay.file, strict=True)]
        done: dict[str, dict[int, None]] = {}
        shard, here, chunk, seen = None, None, None, None  # here: position, file and chunk of the row before
        try:
            for position, file, inner, place, plane in self._pieces(iterator):
                if here != (position, file, inner):
                    if shard:
                        shard.add(here[2], self._pack(chunk))
                    if not here or here[:2] != (position, file):
                        if shard:
                            shard.close()
                            shard = None
                        number = int(np.ravel_multi_index(file, counts))
                        if number in done.setdefault(position, {}):
                            raise ValueError("rows of a shard must come together: use store.write")
                        done[position][number] = None
                        folder = base if position == "0" else f"{base}/{position}"
                        shard = _Shard(system, f"{folder}/0/{lay.name(file)}", lay)
                    chunk, seen, here = np.zeros(lay.chunk, dtype), np.zeros(lay.chunk, bool), (position, file, inner)
                y, x = (slice(p, p + n) for p, n in zip(place[3:], plane.shape, strict=True))
                at = (*place[:3], y, x)
                if seen[at].any():
                    raise ValueError(f"pixels of position {position} came twice")
                with np.errstate(invalid="ignore"):
                    values = plane.astype(dtype)
                if not np.array_equal(values.astype(np.float64), plane.astype(np.float64), equal_nan=dtype.kind == "f"):
                    raise ValueError(f"pixels of position {position} are null or do not fit {dtype.name}")
                chunk[at], seen[at] = values, True
            if shard:
                shard.add(here[2], self._pack(chunk))
                shard.close()
                shard = None
        finally:
            if shard:
                shard.drop()
        return Written({p: np.array(list(n), np.int64) for p, n in done.items()})

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _located(self.path)
        files: dict[str, list[np.ndarray]] = {}
        for message in messages:
            for position, numbers in (message.files if message else {}).items():
                files.setdefault(position, []).append(numbers)
        for position, parts in files.items():
            numbers = np.concatenate(parts)
            if len(np.unique(numbers)) < len(numbers):
                raise ValueError(f"two tasks made one shard of position {position}: use store.write")
        if "0" in files and len(files) > 1 or any(len(p.split("/")) != 3 for p in files if p != "0"):
            raise ValueError("positions must be row/column/field, or a single '0'")
        keys = sorted(files) or ["0"]
        own, lay = self.options, self.layout
        sharding = {"chunk_shape": lay.chunk, "codecs": lay.array["codecs"], "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}
        array = {
            "zarr_format": 3,
            "node_type": "array",
            "shape": lay.shape,
            "data_type": own["data_type"],
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": lay.file}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
            "fill_value": 0,
            "codecs": [{"name": "sharding_indexed", "configuration": sharding}],
            "attributes": {},
            "dimension_names": list(AXES),
        }
        kinds = {"t": "time", "c": "channel"}
        axes = [{"name": a, "type": kinds.get(a, "space")} for a in AXES]
        scale = [{"type": "scale", "scale": own["scale"]}]
        image = {"multiscales": [{"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": scale}]}], "omero": {"channels": [{"label": c} for c in own["channels"]]}}

        def put(folder: str, document: dict[str, Any]) -> None:
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/zarr.json", compression=None) as out:
                out.write(json.dumps(document).encode())

        def group(ome: dict[str, Any], **more: Any) -> dict[str, Any]:
            return {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", **ome}, **more}}

        def put_field(key: str) -> None:
            put(f"{base}/{key}/0", array)
            put(f"{base}/{key}", group(image, summary=own["summary"]))

        if keys == ["0"]:
            put(f"{base}/0", array)
            put(base, group(image, summary=own["summary"]))
            return
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(put_field, keys))
        wells: dict[str, list[str]] = {}
        for key in keys:
            well, name = key.rsplit("/", 1)
            wells.setdefault(well, []).append(name)
        for row in {well.split("/")[0] for well in wells}:
            put(f"{base}/{row}", {"zarr_format": 3, "node_type": "group", "attributes": {}})
        for well, names in wells.items():
            put(f"{base}/{well}", group({"well": {"images": [{"path": n} for n in names]}}))
        rows, columns = (sorted({well.split("/")[k] for well in wells}) for k in (0, 1))
        listed = [{"path": w, "rowIndex": rows.index(w.split("/")[0]), "columnIndex": columns.index(w.split("/")[1])} for w in wells]
        put(base, group({"plate": {"rows": [{"name": r} for r in rows], "columns": [{"name": c} for c in columns], "wells": listed}}))

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _located(self.path)
        if _exists(system, base):
            system.delete_dir(base)


class ImageStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> ImageStoreReader:
        return ImageStoreReader(self.options["path"], int(self.options.get("files_per_task", FILES_PER_TASK)))

    def writer(self, schema, overwrite: bool) -> ImageStoreWriter:
        return ImageStoreWriter(self.options["path"], self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageStore)


def read(spark: SparkSession, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Parts of planes of all positions. Filter on position, t, c and z to open only what is asked for."""
    if not _exists(*_located(path)):
        raise FileNotFoundError(path)
    register(spark)
    return spark.read.format(FORMAT).option("files_per_task", files_per_task).load(path)


def write(
    frames: DataFrame,
    path: str,
    shape: tuple[int, ...],
    data_type: str,
    chunk: tuple[int, ...] | None = None,
    shard: tuple[int, ...] | None = None,
    codec: str | None = "zstd",
    scale: tuple[float, ...] = (1.0,) * 5,
    channels: list[str] | None = None,
    summary: dict | None = None,
) -> None:
    """Write parts of planes (``ngff.FRAMES``) as a sharded store with metadata, never over what is there.

    A chunk is by default a volume of at most 512 planes, a shard all chunks of a timepoint and channel. Parts are cut at
    the borders of chunks and meet their shard by one exchange; what no row covers is zero. Pixels that come twice, are
    null or do not fit the data type, places outside the shape, and a path that exists are errors; a write that fails
    removes what it wrote.
    """
    if codec not in (None, "zstd", "gzip"):
        raise ValueError(f"codec {codec!r} needs a library that is not part of this one")
    if len(shape) != 5 or min(shape) < 1:
        raise ValueError(f"shape must be five sizes of t, c, z, y, x, not {shape}")
    chunk = list(chunk or (1, 1, min(512, shape[2]), *shape[3:]))
    shard = list(shard or (1, 1, *(-(-n // c) * c for n, c in zip(shape[2:], chunk[2:], strict=True))))
    if len(chunk) != 5 or len(shard) != 5 or min(chunk) < 1 or any(s < c or s % c for s, c in zip(shard, chunk, strict=True)):
        raise ValueError(f"chunks {chunk} do not fill shards {shard}")
    register(frames.sparkSession)
    rows = frames.select(*NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            pixels = batch.column("pixels")
            for k, row in enumerate(batch.select(NAMES[:-1]).to_pylist()):
                if not pixels[k].is_valid or pixels[k].values.null_count or None in row.values():
                    raise ValueError("parts of planes must have a position, place, size and pixels")
                plane = pixels[k].values.to_numpy(zero_copy_only=False).reshape(row["ny"], row["nx"])
                ends = [(row[s], row[s] + row[n]) for s, n in (("y0", "ny"), ("x0", "nx"))]
                spans = [[(max(a, i * c), min(b, (i + 1) * c)) for i in range(a // c, -(-b // c))] for (a, b), c in zip(ends, chunk[3:], strict=True)]
                for (y, y_end), (x, x_end) in product(*spans):
                    part = plane[y - row["y0"] : y_end - row["y0"], x - row["x0"] : x_end - row["x0"]]
                    out.append((row["position"], row["t"], row["c"], row["z"], y, x, *part.shape, part.astype(np.float64).ravel()))
                    held += out[-1][-1].nbytes
                    if held > SENT:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    starts = ("t", "c", "z", "y0", "x0")
    files = [F.floor(F.col(s) / F.lit(n)) for s, n in zip(starts, shard, strict=True)]
    chunks = [F.floor(F.col(s) / F.lit(n)) for s, n in zip(starts, chunk, strict=True)]
    dealt = rows.mapInArrow(cut, FRAMES).repartition("position", *files).sortWithinPartitions("position", *files, *chunks)
    layout = {"shape": list(shape), "chunk": chunk, "shard": shard, "data_type": data_type, "codec": codec, "scale": list(scale), "channels": channels or [], "summary": summary or {}}
    dealt.write.format(FORMAT).mode("append").option("layout", json.dumps(layout)).save(path)
