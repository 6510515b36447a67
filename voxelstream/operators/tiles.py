"""Volumes as tiles, for volumes that no row could hold.

A tile is a row (key, z0, y0, x0, nz, ny, nx, voxels): where it begins in its volume, its size and its values in
order. Tiles lie on a grid; those at the far borders may be smaller. All volumes of a table have one ``shape``.

* Correlation: tiles are dealt to planes, whose two-dimensional spectra are dealt to blocks of rows over all planes; there
  the spectra meet along z, and go back to planes, each of which gives its own peak. The peak of all is a reduction.
* Blur: along each axis a tile sends its neighbours the lines that their kernels reach, borders reflected; a kernel may
  reach over several tiles.
* Windows: tiles send their parts to overlapping windows, a model makes channels of each, and weighted parts go back to
  tiles, where they are summed.
* Deskewing: a tile sends its weighted share of each output tile that it reaches, and shares are summed.
* Masks: bounds and histograms are sums over tiles; thresholds come from the histogram, whatever the volume's size.

No group holds more than a plane, a block of rows (about BLOCK bytes) or a tile with its borders.
"""

from __future__ import annotations

import itertools
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels
from ..functions.batches import give_back, slices
from ..sources.shared import stored
from . import stats

Shape = tuple[int, int, int]

BLOCK = 32 << 20  # bytes of complex numbers of one volume that meet in one group
SENT = 16 << 20  # bytes that a task gathers before it sends them on
OBJECT = 48  # bytes that a Python value takes beside its data
STARTS, SIZES = ("z0", "y0", "x0"), ("nz", "ny", "nx")


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _schema(df: DataFrame, key: str, rest: str) -> StructType:
    return StructType.fromDDL(f"`{key}` {_key_type(df, key)}, {rest}")


TILE = ", ".join([*(f"{c} int" for c in (*STARTS, *SIZES)), "voxels array<double>"])


def from_voxels(voxels: DataFrame, key: str, shape: Shape, tile: Shape, value: str = "v") -> DataFrame:
    """Long rows (key, z, y, x, value) -> tiles. A volume's missing voxels are an error of its tiles' sizes."""
    starts = {s: (F.floor(F.col(a) / F.lit(t)) * t).cast("int") for s, a, t in zip(STARTS, "zyx", tile, strict=True)}
    placed = voxels.select(key, "z", "y", "x", F.col(value).cast("double").alias("_v")).withColumns(starts)
    sizes = {c: F.least(F.lit(t), F.lit(n) - F.col(s)).cast("int") for c, s, t, n in zip(SIZES, STARTS, tile, shape, strict=True)}
    cells = placed.groupBy(key, *STARTS).agg(F.sort_array(F.collect_list(F.struct("z", "y", "x", "_v"))).alias("_cells"))
    return cells.select(key, *STARTS, *[c.alias(n) for n, c in sizes.items()], F.col("_cells._v").alias("voxels"))


def to_voxels(tiles: DataFrame, key: str) -> DataFrame:
    """Tiles -> long rows (key, z, y, x, v)."""
    long = tiles.select(key, *STARTS, "ny", "nx", F.posexplode("voxels").alias("_i", "v"))
    plane = F.col("ny") * F.col("nx")
    z, y, x = F.floor(F.col("_i") / plane), F.floor(F.pmod("_i", plane) / F.col("nx")), F.pmod("_i", "nx")
    return long.select(key, *[(F.col(s) + c).cast("long").alias(a) for a, s, c in zip("zyx", STARTS, (z, y, x), strict=True)], "v")


def _array(row) -> np.ndarray:
    return np.asarray(row.voxels, np.float64).reshape(row.nz, row.ny, row.nx)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    """Python values of columns; lists of numbers as arrays."""
    out = []
    for name in names:
        column = batch.column(name)
        if pa.types.is_list(column.type):
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out.append([flat[a:b] for a, b in itertools.pairwise(ends)])
        elif column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
            out.append(column.to_numpy().tolist())
        else:
            out.append(column.to_pylist())
    return out


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, sent on when they hold about SENT bytes."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(OBJECT + (x.nbytes if isinstance(x, np.ndarray) else len(x) if isinstance(x, bytes) else 0) for x in row)
        if size > SENT:
            yield batch(held)
            held, size = [], 0
    yield batch(held)
    del held
    give_back()


def _over_rows(tiles: DataFrame, columns: list[str], schema: StructType, of_row: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """The rows that ``of_row`` makes of each row."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_type = namedtuple("Row", columns, rename=True)
        rows = (out for batch in slices(batches) for row in zip(*_columns(batch, columns), strict=True) for out in of_row(row_type(*row)))
        return _sent(rows, arrow)

    return tiles.select(*columns).mapInArrow(run, schema)


Group = dict[str, list]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[Group]:
    """Rows of sorted batches by equal keys: one group is held, and few rows of the Arrow batch beside it."""
    known, held = None, [[] for _ in names]
    for batch in slices(batches, 64):
        columns = _columns(batch, names)
        marks = list(zip(*columns[: len(keys)], strict=True))
        at = 0
        while at < len(marks):
            if marks[at] != known:
                if held[0]:
                    yield dict(zip(names, held, strict=True))
                known, held = marks[at], [[] for _ in names]
            end = at + 1
            while end < len(marks) and marks[end] == known:
                end += 1
            for own, column in zip(held, columns, strict=True):
                own += column[at:end]
            at = end
    if held[0]:
        yield dict(zip(names, held, strict=True))


def _over_groups(rows: DataFrame, keys: list[str], schema: StructType, of_group: Callable[[Group], list[tuple]]) -> DataFrame:
    """The rows that ``of_group`` makes of each group of rows with equal keys.

    Rows are dealt and sorted by key, and a task goes through its groups in one stream: small volumes make many of them,
    and Spark's own calls for each group took most of their time.
    """
    arrow, names = to_arrow_schema(schema), [*keys, *(c for c in rows.columns if c not in keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent((out for group in _groups(batches, keys, names) for out in of_group(group)), arrow)

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _first(group: Group, *names: str) -> list:
    return [group[n][0] for n in names]


def _lists(group: Group, *names: str) -> list[list]:
    return [group[n] for n in names]


# --- correlation -----------------------------------------------------------------------------------------


def _plane_pieces(tiles: DataFrame, key: str) -> DataFrame:
    """Tiles -> their parts of each plane."""

    def pieces(row) -> Iterator[tuple]:
        for k, plane in enumerate(_array(row)):
            yield row[0], row.z0 + k, row.y0, row.x0, row.ny, row.nx, plane.tobytes()

    return _over_rows(tiles, [key, *STARTS, *SIZES, "voxels"], _schema(tiles, key, "z int, y0 int, x0 int, ny int, nx int, data binary"), pieces)


def _put_together(group: Group, shape: tuple[int, int]) -> np.ndarray:
    plane = np.full(shape, np.nan)
    for y, x, ny, nx, data in zip(*_lists(group, "y0", "x0", "ny", "nx", "data"), strict=True):
        plane[y : y + ny, x : x + nx] = np.frombuffer(data).reshape(ny, nx)
    if np.isnan(plane).any():
        raise ValueError("a plane lacks voxels")
    return plane


def padded_shape(shape: Shape, maximum_shift: float = 1.0) -> Shape:
    """The shape that volumes are brought to before they are correlated."""
    return tuple(kernels.next_fast_length(int(n * maximum_shift)) for n in shape)


def spectra(tiles: DataFrame, key: str, shape: Shape, padded: Shape) -> DataFrame:
    """(key, zp, block, data): two-dimensional spectra of the padded volume's planes, cut into blocks of rows."""
    depth, height, width = padded
    source = kernels.match_shape(np.arange(shape[0]), (depth,))
    rows = max(1, BLOCK // (depth * (width // 2 + 1) * 16))

    def transform(group: Group) -> list[tuple]:
        number, z = _first(group, key, "z")
        spectrum = np.fft.rfft2(kernels.match_shape(_put_together(group, shape[1:]), (height, width)))
        cuts = [(at // rows, spectrum[at : at + rows].tobytes()) for at in range(0, height, rows)]
        return [(number, zp, block, data) for zp in np.flatnonzero(source == z).tolist() for block, data in cuts]

    wanted = _plane_pieces(tiles, key)
    if len(used := np.unique(source).tolist()) < shape[0]:
        wanted = wanted.where(F.col("z").isin(used))
    return _over_groups(wanted, [key, "z"], _schema(tiles, key, "zp int, block int, data binary"), transform)


SURFACE = "plane int, greatest double, least double, total double, at long"


Profiles = tuple[np.ndarray, np.ndarray, np.ndarray]


def surfaces(tiles: DataFrame, pairs: DataFrame, key: str, shape: Shape, maximum_shift: float = 1.0, normalize: str = "none", profiles: Profiles | None = None) -> DataFrame:
    """A row for each pair (pair, reference, moving: keys of tiles) and plane of its correlation surface.

    The surface has the zero shift in the middle; ``at`` is the first place of the plane's greatest value in it.
    ``profiles`` along z, y and x are given where one product of them is the reference of all pairs: its spectrum is the
    product of theirs, which each group makes for its own block, and no volume of it is moved.
    """
    if normalize not in ("none", "magnitude"):
        raise ValueError(f"unknown normalization {normalize!r}")
    depth, height, width = padded = padded_shape(shape, maximum_shift)
    half = width // 2 + 1
    blocks = spectra(tiles, key, shape, padded)
    sides = {k: pairs.select("pair", F.col(c).alias(key)).join(blocks, key).select("pair", F.lit(k).alias("side"), "zp", "block", "data") for k, c in enumerate(("reference", "moving")) if k or profiles is None}
    rows = max(1, BLOCK // (depth * half * 16))
    lines = profiles and [f(kernels.match_shape(p, (n,))) for f, p, n in zip((np.fft.fft, np.fft.fft, np.fft.rfft), profiles, padded, strict=True)]

    def along_z(group: Group) -> list[tuple]:
        pair, block = _first(group, "pair", "block")
        both: dict[int, list] = {0: [None] * depth, 1: [None] * depth}
        for side, zp, data in zip(*_lists(group, "side", "zp", "data"), strict=True):
            both[side][zp] = np.frombuffer(data, np.complex128)
        moving = np.fft.fft(np.stack(both[1]), axis=0)
        if lines is None:
            reference = np.fft.fft(np.stack(both[0]), axis=0)
        else:
            reference = np.einsum("z,y,x->zyx", lines[0], lines[1][block * rows : (block + 1) * rows], lines[2]).reshape(moving.shape)
        product = reference * np.conj(moving)
        if normalize == "magnitude":
            product /= np.maximum(np.abs(product), np.finfo(np.float32).eps)
        return [(pair, zp, block, plane.tobytes()) for zp, plane in enumerate(np.fft.ifft(product, axis=0))]

    def peak(group: Group) -> list[tuple]:
        pair, zp = _first(group, "pair", "zp")
        parts = dict(zip(*_lists(group, "block", "data"), strict=True))
        spectrum = np.concatenate([np.frombuffer(parts[k], np.complex128) for k in sorted(parts)]).reshape(height, half)
        plane = np.fft.fftshift(np.abs(np.fft.irfft2(spectrum, s=(height, width))))
        place = (zp + depth // 2) % depth
        first = int(np.argmax(np.round(plane, 9)))
        return [(pair, place, float(plane.max()), float(plane.min()), float(plane.sum()), place * height * width + first)]

    met = _over_groups(sides[1] if profiles else sides[0].unionByName(sides[1]), ["pair", "block"], _schema(pairs, "pair", "zp int, block int, data binary"), along_z)
    return _over_groups(met, ["pair", "zp"], _schema(pairs, "pair", SURFACE), peak)


def shifts(tiles: DataFrame, pairs: DataFrame, key: str, shape: Shape, maximum_shift: float = 1.0, normalize: str = "none", profiles: Profiles | None = None) -> DataFrame:
    """pair, dz, dy, dx: pixels by which the moving volume lies beyond its reference; the first of equal peaks."""
    depth, height, width = padded_shape(shape, maximum_shift)
    best = surfaces(tiles, pairs, key, shape, maximum_shift, normalize, profiles).groupBy("pair").agg(F.max(F.struct(F.round("greatest", 9).alias("v"), (-F.col("at")).alias("at"))).alias("_best"))
    at = -F.col("_best.at")
    place = (F.floor(at / F.lit(height * width)), F.floor(F.pmod(at, F.lit(height * width)) / F.lit(width)), F.pmod(at, F.lit(width)))
    return best.select("pair", *[(F.lit(n // 2) - p).cast("double").alias(f"d{a}") for a, n, p in zip("zyx", (depth, height, width), place, strict=True)])


def inverse_filtered(tiles: DataFrame, key: str, shape: Shape, transfer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], regularization: float) -> DataFrame:
    """What a given transfer function was applied to, by regularised division of spectra; tiles of one whole plane each.

    ``transfer`` gets frequencies (cycles a voxel) along z, y and x, shaped to be broadcast, and gives the function's
    values there. The spectrum S becomes S conj(H) / (|H|^2 + regularization); volumes are taken as periodic.
    """
    depth, height, width = shape
    half = width // 2 + 1
    rows = max(1, BLOCK // (depth * half * 16))
    z, y, x = np.fft.fftfreq(depth)[:, None, None], np.fft.fftfreq(height)[None, :, None], np.fft.rfftfreq(width)[None, None, :]

    def divide(group: Group) -> list[tuple]:
        number, block = _first(group, key, "block")
        planes = dict(zip(*_lists(group, "zp", "data"), strict=True))
        spectrum = np.fft.fft(np.stack([np.frombuffer(planes[k], np.complex128).reshape(-1, half) for k in range(depth)]), axis=0)
        h = transfer(z, y[:, block * rows : block * rows + spectrum.shape[1]], x)
        back = np.fft.ifft(spectrum * np.conj(h) / (np.abs(h) ** 2 + regularization), axis=0)
        return [(number, k, block, plane.tobytes()) for k, plane in enumerate(back)]

    def plane(group: Group) -> list[tuple]:
        number, k = _first(group, key, "zp")
        parts = dict(zip(*_lists(group, "block", "data"), strict=True))
        spectrum = np.concatenate([np.frombuffer(parts[b], np.complex128) for b in sorted(parts)]).reshape(height, half)
        return [(number, k, 0, 0, 1, height, width, np.fft.irfft2(spectrum, s=(height, width)).ravel())]

    divided = _over_groups(spectra(tiles, key, shape, shape), [key, "block"], _schema(tiles, key, "zp int, block int, data binary"), divide)
    return _over_groups(divided, [key, "zp"], _schema(tiles, key, TILE), plane)


# --- blur and masks --------------------------------------------------------------------------------------


def reflected(places: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the borders of 0..n-1 as they are mirrored at its first and last element."""
    if n == 1:
        return np.zeros_like(places)
    folded = np.abs(places) % (2 * n - 2)
    return np.minimum(folded, 2 * n - 2 - folded)


def _along(tiles: DataFrame, key: str, n: int, step: int, axis: int, sigma: float) -> DataFrame:
    """One pass of the blur. ``n`` is the volume's size along the axis, ``step`` the tiles'."""
    radius = min(int(4 * sigma + 0.5), n - 1)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    start, size = STARTS[axis], SIZES[axis]
    #: For each tile's start, the lines that it needs.
    needed = {t: np.unique(reflected(np.arange(t - radius, min(t + step, n) + radius), n)) for t in range(0, n, step)}
    takers = {s: [(t, own) for t, lines in needed.items() if len(own := lines[(lines >= s) & (lines < s + step)])] for s in needed}

    def send(row) -> Iterator[tuple]:
        block, own = _array(row), row._asdict()
        for target, lines in takers[own[start]]:
            sizes = {**{c: own[c] for c in SIZES}, size: min(step, n - target)}
            part = np.take(block, lines - own[start], axis=axis)
            yield (row[0], *({**own, start: target}[c] for c in STARTS), *sizes.values(), lines.astype(np.int64).tobytes(), part.tobytes())

    def meet(group: Group) -> list[tuple]:
        number, *place_of = _first(group, key, *STARTS, *SIZES)
        begin, shape = place_of[axis], place_of[3:]
        lines = [np.frombuffer(x, np.int64) for x in group["lines"]]
        parts = [np.frombuffer(x).reshape([len(own) if a == axis else m for a, m in enumerate(shape)]) for own, x in zip(lines, group["data"], strict=True)]
        place = np.empty(n, np.int64)
        place[np.concatenate(lines)] = np.arange(sum(map(len, lines)))
        wide = np.take(np.concatenate(parts, axis=axis), place[reflected(np.arange(begin - radius, begin + shape[axis] + radius), n)], axis=axis)
        out = sum(w * np.take(wide, np.arange(k, k + shape[axis]), axis=axis) for k, w in enumerate(weights))
        return [(number, *place_of, out.ravel())]

    fields = ", ".join([*(f"{c} int" for c in (*STARTS, *SIZES)), "lines binary, data binary"])
    sent = _over_rows(tiles, [key, *STARTS, *SIZES, "voxels"], _schema(tiles, key, fields), send)
    return _over_groups(sent, [key, *STARTS], _schema(tiles, key, TILE), meet)


def blurred(tiles: DataFrame, key: str, shape: Shape, tile: Shape, sigma: float) -> DataFrame:
    """Gaussian blur with reflected borders, axis by axis; no blur for sigma <= 0."""
    for axis, (n, step) in enumerate(zip(shape, tile, strict=True)):
        if sigma > 0 and n > 1:
            tiles = _along(tiles, key, n, step, axis, sigma)
    return tiles


def bounds(tiles: DataFrame, key: str) -> DataFrame:
    """key, lo, hi of each volume."""
    return tiles.groupBy(key).agg(F.min(F.array_min("voxels")).alias("lo"), F.max(F.array_max("voxels")).alias("hi"))


def histogram(tiles: DataFrame, key: str, bins: int = 256) -> DataFrame:
    """As ``stats.histogram`` of the voxels: tiles count their own, sums merge them."""

    def count(row) -> Iterator[tuple]:
        values, span = np.asarray(row.voxels), row.hi - row.lo
        at = np.minimum((values - row.lo) / span * bins, bins - 1).astype(np.int64) if span else np.zeros(len(values), np.int64)
        n = np.bincount(at, minlength=bins)
        for place in np.flatnonzero(n).tolist():
            yield row[0], row.lo, row.hi, place, int(n[place])

    counted = _over_rows(tiles.join(bounds(tiles, key), key), [key, "lo", "hi", "voxels"], _schema(tiles, key, "lo double, hi double, bin long, n long"), count)
    return counted.groupBy(key, "lo", "hi", "bin").agg(F.sum("n").alias("n"))


def thresholds(h: DataFrame, key: str, bins: int = 256) -> DataFrame:
    """key, low, high: two Otsu thresholds of each volume's ``histogram``; a group holds at most ``bins`` rows."""

    def cut(group: Group) -> list[tuple]:
        number, low, high = _first(group, key, "lo", "hi")
        counts = np.zeros(bins)
        counts[group["bin"]] = group["n"]
        return [(number, *(kernels.otsu_of_counts(counts, low, high) if low < high else (low, low)))]

    return _over_groups(h, [key], _schema(h, key, "low double, high double"), cut)


def masks(tiles: DataFrame, key: str, shape: Shape, tile: Shape, sigma: float, component: int) -> DataFrame:
    """Tiles of zeros and ones: rescaled to 0..1, blurred, above the chosen Otsu threshold; nothing of a constant volume.

    What is read more than once is stored: a blur moves all borders, and is not done again.
    """
    span = F.col("hi") - F.col("lo")
    unit = F.transform("voxels", lambda v: F.coalesce(F.try_divide(v - F.col("lo"), span), F.lit(0.0)))
    tiles = stored(tiles, "tiles")
    soft = stored(blurred(tiles.join(bounds(tiles, key), key).withColumn("voxels", unit).drop("lo", "hi"), key, shape, tile, sigma), "soft-tiles")
    cuts = thresholds(histogram(soft, key), key).select(key, F.col("low" if component == 0 else "high").alias("_cut"))
    return soft.join(cuts, key).withColumn("voxels", F.transform("voxels", lambda v: (v > F.col("_cut")).cast("double"))).drop("_cut")


def _tile_sums(tiles: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """key, _total and _z, _y, _x: sums of values, and of values times places, by volume."""

    def add(row) -> Iterator[tuple]:
        block = _array(row)
        moments = [float(block.sum(axis=tuple(b for b in range(3) if b != a)) @ (np.arange(block.shape[a]) + row[1 + a])) for a in range(3)]
        yield (row[0], float(block.sum()), *moments)

    weighted = tiles if weight is None else tiles.withColumn("voxels", weight)
    sums = _over_rows(weighted, [key, *STARTS, *SIZES, "voxels"], _schema(tiles, key, "_total double, _z double, _y double, _x double"), add)
    return sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_total", "_z", "_y", "_x")])


def mask_centers(mask: DataFrame, key: str) -> DataFrame:
    """key, c_z, c_y, c_x: mean place of the set voxels; the origin for none."""
    at = lambda a: F.coalesce(F.try_divide(F.col(f"_{a}"), F.col("_total")), F.lit(0.0)).alias(f"c_{a}")
    return _tile_sums(mask, key).select(key, *[at(a) for a in "zyx"])


def intensity_centers(tiles: DataFrame, key: str, shape: Shape, background: DataFrame | None = None) -> DataFrame:
    """key, c_z, c_y, c_x: mean place weighted by what is above the background (key, percentile), or above zero.

    The geometric centre if nothing is.
    """
    based = tiles.withColumn("percentile", F.lit(0.0)) if background is None else tiles.join(background, key)
    above = F.transform("voxels", lambda v: F.greatest(v - F.col("percentile"), F.lit(0.0)))
    at = lambda a, n: F.when(F.col("_total") > 0, F.try_divide(F.col(f"_{a}"), F.col("_total"))).otherwise((n - 1) / 2).alias(f"c_{a}")
    return _tile_sums(based, key, above).select(key, *[at(a, n) for a, n in zip("zyx", shape, strict=True)])


def blob_profiles(shape: Shape, sigma: float) -> Profiles:
    """Along z, y and x: what a Gaussian blob about the middle of a volume is the product of."""
    return tuple(np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / sigma) ** 2) for n in shape)


def settings_shifts(tiles: DataFrame, pairs: DataFrame, key: str, shape: Shape, tile: Shape, tracking: dict) -> DataFrame:
    """pair, dz, dy, dx by checked tracking settings: the method they name, with its own section."""
    method, otsu, roi, maximum = tracking["tracking_method"], tracking["segmentation"], tracking["roi_center"], tracking["shift"]["maximum"]
    if method == "pcc":
        return shifts(tiles, pairs, key, shape, maximum)
    if method in ("multiotsu_pcc", "multiotsu_center_of_mass"):
        mask = masks(tiles, key, shape, tile, otsu["otsu_sigma"], otsu["otsu_component"])
        if method == "multiotsu_pcc":
            return shifts(mask, pairs, key, shape, maximum)
        centers = mask_centers(mask, key)
        sides = [centers.select(F.col(key).alias(side), *[F.col(f"c_{a}").alias(f"{side}_{a}") for a in "zyx"]) for side in ("reference", "moving")]
        both = pairs.join(sides[0], "reference").join(sides[1], "moving")
        return both.select("pair", *[(F.col(f"moving_{a}") - F.col(f"reference_{a}")).alias(f"d{a}") for a in "zyx"])
    if method == "roi_center_pcc":
        return shifts(tiles, pairs, key, shape, maximum, profiles=blob_profiles(shape, roi["blob_sigma"]))
    if method != "intensity_center_of_mass":
        raise ValueError(f"unknown tracking method {method!r}")
    soft = stored(blurred(tiles, key, shape, tile, roi["blur_sigma"]), "soft-tiles")
    percent = roi["background_percentile"]
    background = None if percent is None else stats.percentile_of_histogram(histogram(soft, key), [key], percent)
    centers = intensity_centers(soft, key, shape, background)
    return pairs.join(centers.withColumnRenamed(key, "moving"), "moving").select("pair", *[(F.col(f"c_{a}") - (n - 1) / 2).alias(f"d{a}") for a, n in zip("zyx", shape, strict=True)])


# --- overlapping windows ---------------------------------------------------------------------------------


def window_starts(n: int, window: int, overlap: int) -> list[int]:
    """Where windows begin along an axis; the last one ends with it. One window as long as the axis where that is shorter."""
    if not 0 <= overlap < window:
        raise ValueError("windows must overlap by less than their size")
    last = max(n - window, 0)
    return sorted({*range(0, last, window - overlap), last})


def _shares(n: int, window: int, overlap: int) -> dict[int, np.ndarray]:
    """For each window's start the weight of its elements: ramps at its ends, and all weights of an element sum to one."""
    size = min(window, n)
    ramp = np.minimum(np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)) / (overlap + 1), 1.0)
    total = np.zeros(n)
    for s in (starts := window_starts(n, window, overlap)):
        total[s : s + size] += ramp
    return {s: ramp / total[s : s + size] for s in starts}


Model = Callable[[np.ndarray], dict[str, np.ndarray]]


def windowed(tiles: DataFrame, key: str, shape: Shape, tile: Shape, window: Shape, overlap: Shape, model: Model) -> DataFrame:
    """Tiles of each channel that ``model`` makes of overlapping windows, blended where they overlap; with ``channel``.

    The model gets a window and gives arrays of its shape by channel. A group holds a window, or a tile and the parts of
    windows that lie on it.
    """
    shares = [_shares(n, w, o) for n, w, o in zip(shape, window, overlap, strict=True)]
    extent = [min(w, n) for w, n in zip(window, shape, strict=True)]
    corners = [range(0, n, t) for n, t in zip(shape, tile, strict=True)]

    def meets(begin: list[int], size: list[int], others: list, length: list[int]) -> Iterator[tuple[list[int], list[slice]]]:
        """The boxes that begin at ``others`` and meet this one, and where they meet."""
        along = [[(s, slice(max(b, s), min(b + m, s + k))) for s in own if s < b + m and b < s + k] for b, m, own, k in zip(begin, size, others, length, strict=True)]
        for z, y, x in itertools.product(*along):
            yield [z[0], y[0], x[0]], [z[1], y[1], x[1]]

    def moved(cut: list[slice], by: list[int]) -> tuple[slice, ...]:
        return tuple(slice(c.start - b, c.stop - b) for c, b in zip(cut, by, strict=True))

    def to_windows(row) -> Iterator[tuple]:
        block, begin = _array(row), [row.z0, row.y0, row.x0]
        for start, cut in meets(begin, list(block.shape), [list(s) for s in shares], extent):
            yield row[0], *start, *(c.start for c in cut), *(c.stop - c.start for c in cut), block[moved(cut, begin)].tobytes()

    def filled(group: Group, begin: list[int], size: list[int], add: bool) -> np.ndarray:
        out = np.zeros(size) if add else np.full(size, np.nan)
        for *place, data in zip(*_lists(group, "oz", "oy", "ox", "lz", "ly", "lx", "data"), strict=True):
            at = moved([slice(o, o + m) for o, m in zip(place[:3], place[3:], strict=True)], begin)
            out[at] = out[at] + np.frombuffer(data).reshape(place[3:]) if add else np.frombuffer(data).reshape(place[3:])
        if np.isnan(out).any() and not add:
            raise ValueError("a window lacks voxels")
        return out

    def apply(group: Group) -> list[tuple]:
        number, *start = _first(group, key, "wz", "wy", "wx")
        weight = np.einsum("z,y,x->zyx", *(own[s] for own, s in zip(shares, start, strict=True)))
        out = []
        for channel, made in model(filled(group, start, extent, False)).items():
            if made.shape != tuple(extent):
                raise ValueError(f"channel {channel!r} has the shape {made.shape}, its window {tuple(extent)}")
            for corner, cut in meets(start, extent, corners, list(tile)):
                out.append((number, channel, *corner, *(c.start for c in cut), *(c.stop - c.start for c in cut), (made * weight)[moved(cut, start)].tobytes()))
        return out

    def blend(group: Group) -> list[tuple]:
        number, channel, *corner = _first(group, key, "channel", *STARTS)
        size = [min(t, n - c) for t, n, c in zip(tile, shape, corner, strict=True)]
        return [(number, channel, *corner, *size, filled(group, corner, size, True).ravel())]

    part = "oz int, oy int, ox int, lz int, ly int, lx int, data binary"
    sent = _over_rows(tiles, [key, *STARTS, *SIZES, "voxels"], _schema(tiles, key, f"wz int, wy int, wx int, {part}"), to_windows)
    made = _over_groups(sent, [key, "wz", "wy", "wx"], _schema(tiles, key, f"channel string, z0 int, y0 int, x0 int, {part}"), apply)
    return _over_groups(made, [key, "channel", *STARTS], _schema(tiles, key, f"channel string, {TILE}"), blend)


# --- deskewing -------------------------------------------------------------------------------------------


def deskewed_shape(shape: Shape, angle_degrees: float, ratio: float, average: int = 1, keep_overhang: bool = True) -> Shape:
    """The shape that ``kernels.deskew`` gives."""
    angle = np.deg2rad(angle_degrees)
    overhang, span = int(np.ceil(shape[1] * np.cos(angle))), int(np.ceil(shape[0] / ratio))
    heights = int(np.ceil(shape[1] * np.sin(angle)))
    return -(-heights // average), span + overhang if keep_overhang else max(span - overhang, 1), shape[2]


def deskewed(tiles: DataFrame, key: str, shape: Shape, tile: Shape, angle_degrees: float, ratio: float, average: int = 1, keep_overhang: bool = True) -> DataFrame:
    """``kernels.deskew`` of volumes in tiles: tiles of the output's grid.

    Interpolation is linear, so a voxel adds to the few output voxels around it whatever its tile's neighbours hold: no
    borders are exchanged. Tiles send one block for each output tile that they reach, already summed; a group holds
    an output tile and one block at a time. Output tiles that nothing reaches are zero.
    """
    out_shape = deskewed_shape(shape, angle_degrees, ratio, average, keep_overhang)
    angle, step = np.deg2rad(angle_degrees), 1 / ratio
    first = 0 if keep_overhang else int(np.ceil(shape[1] * np.cos(angle)))
    heights = int(np.ceil(shape[1] * np.sin(angle)))
    corners = [range(0, n, t) for n, t in zip(out_shape, tile, strict=True)]

    def layer(block: np.ndarray, row, height: int) -> tuple[int, np.ndarray] | None:
        """Where the tile's share of one height begins along the coverslip, and the share (along, x)."""
        tilt = height / np.sin(angle)
        near = np.maximum(0, 1 - np.abs(tilt - (row.y0 + np.arange(row.ny))))
        if not near.any():
            return None
        middle = tilt * np.cos(angle) - first
        low = max(int(np.floor((row.z0 - 1) * step + middle)), 0)
        high = min(int(np.ceil((row.z0 + row.nz) * step + middle)) + 1, out_shape[1])
        if low >= high:
            return None
        scan = (np.arange(low, high) - middle) / step
        weights = np.maximum(0, 1 - np.abs(scan[:, None] - (row.z0 + np.arange(row.nz))[None, :]))
        return low, weights @ np.tensordot(near, block, (0, 1))

    def shares(row) -> Iterator[tuple]:
        block = _array(row)
        if (row.z0, row.y0, row.x0) == (0, 0, 0):
            for corner in itertools.product(*corners):
                yield row[0], *corner, 0, 0, 0, 0, 0, 0, b""
        for h0 in corners[0]:
            rows = min(tile[0], out_shape[0] - h0)
            found = []
            for height in range(h0 * average, min((h0 + rows) * average, heights)):
                if share := layer(block, row, height):
                    place = height // average
                    found.append((place - h0, share[0], share[1] / min(average, heights - place * average)))
            if not found:
                continue
            low, high = min(a for _, a, _ in found), max(a + len(v) for _, a, v in found)
            made = np.zeros((rows, high - low, row.nx))
            for h, a, v in found:
                made[h, a - low : a - low + len(v)] += v
            for a0 in range(low // tile[1] * tile[1], high, tile[1]):
                for x0 in range(row.x0 // tile[2] * tile[2], row.x0 + row.nx, tile[2]):
                    a, a_end = max(a0, low), min(a0 + tile[1], high)
                    x, x_end = max(x0, row.x0), min(x0 + tile[2], row.x0 + row.nx)
                    part = made[:, a - low : a_end - low, x - row.x0 : x_end - row.x0]
                    if part.any():
                        yield row[0], h0, a0, x0, 0, a - a0, x - x0, *part.shape, part.tobytes()

    def summed(group: Group) -> list[tuple]:
        number, *corner = _first(group, key, *STARTS)
        size = [min(t, n - c) for t, n, c in zip(tile, out_shape, corner, strict=True)]
        out = np.zeros(size)
        for z, y, x, nz, ny, nx, data in zip(*_lists(group, "oz", "oy", "ox", "lz", "ly", "lx", "data"), strict=True):
            out[z : z + nz, y : y + ny, x : x + nx] += np.frombuffer(data).reshape(nz, ny, nx)
        return [(number, *corner, *size, out.ravel())]

    part = "oz int, oy int, ox int, lz int, ly int, lx int, data binary"
    sent = _over_rows(tiles, [key, *STARTS, *SIZES, "voxels"], _schema(tiles, key, f"z0 int, y0 int, x0 int, {part}"), shares)
    return _over_groups(sent, [key, *STARTS], _schema(tiles, key, TILE), summed)
