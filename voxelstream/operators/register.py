"""Registration of volumes that are on one row with their reference: Arrow-batched kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.config import METHODS, checked


def _shift(method: str, shape: tuple[int, ...], ref: np.ndarray | None, mov: np.ndarray, maximum: float, otsu: dict, roi: dict) -> list[float]:
    if method == "pcc":
        found = kernels.correlation_shift(ref, mov, maximum)
    elif method == "multiotsu_pcc":
        masks = (kernels.binary_mask(v, otsu["otsu_sigma"], otsu["otsu_component"]).astype(np.float64) for v in (ref, mov))
        found = kernels.correlation_shift(*masks, maximum)
    elif method == "multiotsu_center_of_mass":
        a, b = (kernels.center_of_mass(kernels.binary_mask(v, otsu["otsu_sigma"], otsu["otsu_component"])) for v in (ref, mov))
        found = b - a
    elif method == "roi_center_pcc":
        found = kernels.correlation_shift(kernels.centered_blob(shape, roi["blob_sigma"]), mov, maximum)
    else:
        soft = kernels.gaussian_blur(mov, roi["blur_sigma"])
        percent = roi["background_percentile"]
        background = 0.0 if percent is None else kernels.histogram_percentile(soft, percent)
        found = kernels.intensity_center(soft, background) - (np.array(shape) - 1) / 2
    return [float(x) for x in found]


def pixel_shift(method: str, ref: Column, mov: Column, shape: tuple[int, ...], maximum: float = 1.0, segmentation: dict | None = None, roi_center: dict | None = None, guarded: bool = False) -> Column:
    """Shift of ``mov`` against ``ref`` (flat arrays of one shape) in pixels, an array in axis order.

    ``segmentation`` and ``roi_center`` are the sections of tracking settings, or parts of them. If ``guarded``, a
    volume that has no shift (wrong size, nothing in it) gives null, which leaves its position as it was.
    """
    if method not in METHODS:
        raise ValueError(f"unknown tracking method {method!r}")
    otsu, roi = checked("segmentation", segmentation or {}), checked("roi_center", roi_center or {})

    @F.pandas_udf("array<double>")
    def shift(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        volume = lambda v: None if v is None else np.asarray(v, np.float64).reshape(shape)

        def one(ref, mov) -> list[float] | None:
            try:
                return _shift(method, shape, volume(ref), volume(mov), maximum, otsu, roi)
            except (ValueError, TypeError, ArithmeticError, AttributeError):
                if guarded:
                    return None
                raise

        for refs, movs in pairs:
            yield pd.Series([one(r, m) for r, m in zip(refs, movs, strict=True)])

    return shift(ref, mov)


def settings_shift(tracking: dict, ref: Column, mov: Column, shape: tuple[int, ...]) -> Column:
    """``pixel_shift`` by checked tracking settings."""
    return pixel_shift(tracking["tracking_method"], ref, mov, shape, tracking["shift"]["maximum"], tracking["segmentation"], tracking["roi_center"])


def surface(ref: Column, mov: Column, shape: tuple[int, ...], maximum: float = 1.0, normalize: str = "none") -> Column:
    """Greatest and least value and the sum of the correlation of two flat arrays."""

    @F.pandas_udf("struct<greatest:double,least:double,total:double>")
    def describe(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, movs in pairs:
            found = [kernels.correlation(*(np.asarray(v, np.float64).reshape(shape) for v in pair), maximum, normalize) for pair in zip(refs, movs, strict=True)]
            yield pd.DataFrame([(s.max(), s.min(), s.sum()) for s in found], columns=["greatest", "least", "total"])

    return describe(ref, mov)


def blurred(volume: Column, shape: tuple[int, ...], sigma: float) -> Column:
    """Gaussian blur of a flat array."""

    @F.pandas_udf("array<double>")
    def blur(volumes: pd.Series) -> pd.Series:
        return pd.Series([kernels.gaussian_blur(np.asarray(v, np.float64).reshape(shape), sigma).ravel() for v in volumes])

    return blur(volume)
