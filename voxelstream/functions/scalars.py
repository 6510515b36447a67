"""Column helpers with the numeric conventions of image-stream analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(index: Column, size: Column | int) -> Column:
    """An index that wraps around its axis, negative ones too."""
    return F.pmod(index, size if isinstance(size, Column) else F.lit(size))


def clamped(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def z_index(z: Column, center: Column, scale: Column, n_z: Column) -> Column:
    """Slice nearest to a stage height: half-even rounding, clamped; the centre slice for a zero scale."""
    middle = F.floor(n_z / 2).cast("long")
    steps = F.when(scale != 0, F.bround((z - center) / F.nullif(scale, F.lit(0.0)), 0).cast("long")).otherwise(F.lit(0))
    return clamped(middle + steps, F.lit(0).cast("long"), (n_z - 1).cast("long"))


def round6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)


def fixed4(value: Column) -> Column:
    """Text with four decimals; null is an empty text."""
    return F.when(value.isNull(), "").otherwise(F.format_string("%.4f", value))


def first_match(name: Column, choices: list[tuple[str, str]], default: str) -> Column:
    """The value of the first choice whose key is part of ``name``, in any case."""
    found, low = F.lit(default), F.lower(name)
    for part, value in reversed(choices):
        found = F.when(low.contains(part), F.lit(value)).otherwise(found)
    return found


#: Ranges of integer types.
INTEGER_RANGES = {"uint8": (0.0, 255.0), "int8": (-128.0, 127.0), "uint16": (0.0, 65535.0), "int16": (-32768.0, 32767.0), "uint32": (0.0, 4294967295.0), "int32": (-2147483648.0, 2147483647.0)}


def display_range(dtype: Column) -> tuple[Column, Column]:
    """Contrast limits to begin with: the range of an integer type, 0..1 for any other."""
    low, high = F.lit(0.0), F.lit(1.0)
    for name, (least, greatest) in INTEGER_RANGES.items():
        low, high = F.when(dtype == name, least).otherwise(low), F.when(dtype == name, greatest).otherwise(high)
    return low, high


def well_place(well: Column) -> tuple[Column, Column]:
    """Row and column of a well id: its first character, and the rest."""
    return F.substring(well, 1, 1), F.substring(well, 2, 1_000_000)
