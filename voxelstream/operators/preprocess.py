"""Preprocessing of stacks in a fixed order of steps, whatever order they are listed in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.config import STEPS

Volumes = Callable[[DataFrame], DataFrame]


def flatfield_volumes(volumes: DataFrame) -> DataFrame:
    """Flat-field of rows (nz, ny, nx, voxels): each value over its pixel's median along z, times their mean."""

    @F.pandas_udf("array<double>")
    def flat(nz: pd.Series, ny: pd.Series, nx: pd.Series, voxels: pd.Series) -> pd.Series:
        def one(z: int, y: int, x: int, v: np.ndarray) -> np.ndarray:
            stack = np.asarray(v, np.float64).reshape(z, y, x)
            median = np.median(stack, axis=0)
            flat = (stack / np.where(median == 0, np.nan, median) * median.mean()).ravel()
            return np.where(np.isnan(flat), None, flat) if (median == 0).any() else flat

        return pd.Series([one(*row) for row in zip(nz, ny, nx, voxels, strict=True)])

    return volumes.withColumn("voxels", flat("nz", "ny", "nx", "voxels"))


def deskew_volumes(volumes: DataFrame, angle_degrees: float, ratio: float, average: int = 1, keep_overhang: bool = True) -> DataFrame:
    """Deskewed rows with their new nz, ny, nx."""

    @F.pandas_udf("struct<nz:int,ny:int,nx:int,voxels:array<double>>")
    def skew(nz: pd.Series, ny: pd.Series, nx: pd.Series, voxels: pd.Series) -> pd.DataFrame:
        rows = []
        for z, y, x, v in zip(nz, ny, nx, voxels, strict=True):
            out = kernels.deskew(np.asarray(v, np.float64).reshape(z, y, x), angle_degrees, ratio, average, keep_overhang)
            rows.append((*out.shape, out.ravel()))
        return pd.DataFrame(rows, columns=["nz", "ny", "nx", "voxels"])

    out = volumes.withColumn("_s", skew("nz", "ny", "nx", "voxels"))
    return out.withColumns({c: F.col(f"_s.{c}") for c in ("nz", "ny", "nx", "voxels")}).drop("_s")


def pipeline(steps: list[str] | None, deskew: dict | None = None, plugins: dict[str, Volumes] | None = None) -> Volumes:
    """The listed steps as one function. Deskew without settings is left out; phase and vs need a plug-in."""
    wanted, plugins, chosen = set(steps or ()), plugins or {}, []
    if unknown := wanted - set(STEPS):
        raise ValueError(f"unknown preprocessing steps {sorted(unknown)}")
    for step in STEPS:
        if step not in wanted:
            continue
        if step == "flatfield":
            chosen.append(flatfield_volumes)
        elif step == "deskew":
            if deskew is not None:
                chosen.append(lambda v: deskew_volumes(v, **deskew))
        elif step in plugins:
            chosen.append(plugins[step])
        else:
            raise ValueError(f"step {step!r} needs a plug-in: its algorithm is not part of this library")

    def run(volumes: DataFrame) -> DataFrame:
        for one in chosen:
            volumes = one(volumes)
        return volumes

    return run
