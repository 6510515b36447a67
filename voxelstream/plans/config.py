"""Settings files: read from YAML or JSON, checked against tables of keys, filled with defaults.

Every unknown key is an error. What comes out are plain mappings, ready for ``registration`` and the plans.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

# Keys and values that settings files are written with.
METHODS = ("pcc", "intensity_center_of_mass", "roi_center_pcc", "multiotsu_center_of_mass", "multiotsu_pcc")
REFERENCELESS = ("intensity_center_of_mass", "roi_center_pcc")
STEPS = ("flatfield", "deskew", "phase", "vs")
RESERVED_CHANNELS = ("phase", "deskewed")
STAINED_CHANNELS = ("nuclei", "membrane")
LEGACY_SECTION = "mantis"
#: Section -> its keys as (key, kind, default); a default of ``...`` means that the key must be given.
SECTIONS: dict[str, list[tuple[str, str, Any]]] = {
    "metadata": [
        ("autofocus", "section autofocus", {}),
        ("dynatrack", "optional section dynatrack", None),
        ("reset_hardware_sequencing_settings", "property triplets", []),
    ],
    "autofocus": [("enabled", "flag", False), ("method", "optional text", None), ("stage", "optional text", None)],
    "dynatrack": [
        ("debug", "flag", False),
        ("deskew", "optional mapping", None),
        ("enabled", "flag", True),
        ("image_to_stage_matrix_xyz", "optional matrix", None),
        ("input_channel", "text", ...),
        ("phase", "optional mapping", None),
        ("preprocessing", "optional steps", None),
        ("reference_update_interval", "count", 0),
        ("roi_center", "section roi_center", {}),
        ("segmentation", "section segmentation", {}),
        ("shift", "section shift", {}),
        ("shift_log_path", "optional text", None),
        ("tracking_channel", "text", ...),
        ("tracking_interval", "count", 1),
        ("tracking_method", "method", "pcc"),
        ("virtual_staining", "optional mapping", None),
        ("z_device", "optional text", None),
    ],
    "shift": [("dampening", "optional triple", None), ("limits", "optional limits", None), ("maximum", "number", 1.0)],
    "segmentation": [("otsu_component", "count", 0), ("otsu_sigma", "number", 5.0)],
    "roi_center": [("background_percentile", "optional number", None), ("blob_sigma", "number", 10.0), ("blur_sigma", "number", 0.0)],
}


def _number(value: Any) -> float:
    if isinstance(value, bool):
        raise ValueError("a number is wanted")
    return float(value)


def _count(value: Any) -> int:
    if isinstance(value, bool) or int(value) != float(value):
        raise ValueError("a whole number is wanted")
    return int(value)


def _typed(kind: type, name: str):
    def check(value: Any) -> Any:
        if not isinstance(value, kind):
            raise ValueError(f"{name} is wanted")
        return value

    return check


def _sized(n: int, of) -> Any:
    def check(value: Any) -> list:
        if not isinstance(value, list | tuple) or len(value) != n:
            raise ValueError(f"{n} values are wanted")
        return [of(v) for v in value]

    return check


def _among(choices: tuple[str, ...]):
    def check(value: Any) -> str:
        if value not in choices:
            raise ValueError(f"must be one of {', '.join(choices)}")
        return value

    return check


def _limits(value: Any) -> dict[str, list[float]]:
    if unknown := set(_typed(dict, "a mapping")(value)) - set("zyx"):
        raise ValueError(f"unknown axes {sorted(unknown)}")
    return {axis: _sized(2, _number)(bounds) for axis, bounds in value.items()}


_KINDS = {
    "flag": _typed(bool, "true or false"),
    "text": lambda v: str(v) if isinstance(v, str | Path) else _typed(str, "a text")(v),
    "mapping": lambda v: dict(_typed(dict, "a mapping")(v)),
    "number": _number,
    "count": _count,
    "triple": _sized(3, _number),
    "matrix": _sized(3, _sized(3, _number)),
    "limits": _limits,
    "method": _among(METHODS),
    "steps": lambda v: [_among(STEPS)(s) for s in _typed(list, "a list")(v)],
    # Values of properties are texts, however a file writes them.
    "property triplets": lambda v: [tuple(_sized(3, str)(row)) for row in _typed(list, "a list")(v)],
}


def checked(section: str, given: dict[str, Any], where: str = "") -> dict[str, Any]:
    """The settings of a section with its defaults; a ValueError names the first key that is wrong."""
    where = where or section
    if not isinstance(given, dict):
        raise ValueError(f"{where}: a mapping is wanted")
    table = {key: (kind, default) for key, kind, default in SECTIONS[section]}
    if unknown := set(given) - set(table):
        raise ValueError(f"{where}: unknown keys {sorted(map(str, unknown))}")
    found = {}
    for key, (kind, default) in table.items():
        value = given.get(key, default)
        if value is ...:
            raise ValueError(f"{where}.{key} is missing")
        optional, kind = kind.startswith("optional "), kind.removeprefix("optional ")
        if value is None and optional:
            found[key] = None
        elif kind.startswith("section "):
            found[key] = checked(kind.removeprefix("section "), value, f"{where}.{key}")
        else:
            try:
                found[key] = _KINDS[kind](value)
            except (TypeError, ValueError) as error:
                raise ValueError(f"{where}.{key}: {error}") from None
    return found


def read_plan(path: str) -> dict[str, Any]:
    """An acquisition file, its ``metadata`` checked and filled. Files that nest it one level deeper are of an old kind and refused."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        plan = json.loads(text)
    else:
        import yaml

        plan = yaml.safe_load(text)
    if not isinstance(plan, dict):
        raise ValueError(f"{path} holds no mapping")
    metadata = plan.get("metadata") or {}
    if isinstance(metadata, dict) and isinstance(metadata.get(LEGACY_SECTION), dict):
        raise ValueError(f"{path}: the settings under metadata.{LEGACY_SECTION} belong directly under metadata")
    return plan | {"metadata": checked("metadata", metadata)}


def tracking_channel(tracking: dict[str, Any], channels: list[str]) -> int:
    """The index of the input channel; a ValueError where a channel cannot be the tracked one."""
    name = tracking["tracking_channel"]
    if name in RESERVED_CHANNELS or name.startswith("vs_"):
        raise ValueError(f"tracking_channel {name!r} is a reserved name")
    stained = "vs" in (tracking["preprocessing"] or [])
    allowed = ((tracking["virtual_staining"] or {}).get("target_channels") or list(STAINED_CHANNELS)) if stained else channels
    if name not in allowed:
        raise ValueError(f"tracking_channel {name!r} is none of {allowed}")
    if tracking["input_channel"] not in channels:
        raise ValueError(f"input_channel {tracking['input_channel']!r} is none of {channels}")
    return channels.index(tracking["input_channel"])


def tracking_plan(tracking: dict[str, Any] | None, n_positions: int, pixel_um: float | None, z_step_um: float | None) -> dict[str, Any] | None:
    """Tracking settings with the scales of the acquisition written into their steps; None where nothing is tracked.

    The settings given stay as they are.
    """
    if tracking is None or not tracking["enabled"] or not n_positions:
        return None
    if not pixel_um:
        raise ValueError("the pixel size is not set")
    if not z_step_um:
        raise ValueError("the z plan has no step")
    found = dict(tracking)
    if tracking["deskew"] is not None:
        found["deskew"] = tracking["deskew"] | {"pixel_size_um": pixel_um, "scan_step_um": z_step_um}
    if tracking["phase"] is not None:
        transfer = tracking["phase"].get("transfer_function") or {}
        found["phase"] = tracking["phase"] | {"transfer_function": transfer | {"yx_pixel_size": pixel_um, "z_pixel_size": z_step_um}}
    return found


def accepted(settings: dict[str, Any], names: set[str]) -> dict[str, Any]:
    """The settings that a function with these parameter names takes."""
    return {k: v for k, v in settings.items() if k in names}


def z_parameters(stage: str | None, start: float | None, end: float | None, step: float | None) -> list[str]:
    """Warnings about a legacy z range, all of whose parameters or none must be given; steps below 0.1 um are an error."""
    given = (stage, start, end, step)
    if any(given) and None in given:
        raise TypeError("stage, start, end and step of z go together")
    if step is not None and step < 0.1:
        raise ValueError("z steps below 0.1 um look like wrong units")
    return ["0.143 um is an outdated z step"] if step == 0.143 else []


def per_channel(value: Any, n_channels: int) -> list:
    """A setting of each channel: a list must have one for each, anything else holds for all."""
    if not isinstance(value, list):
        return [value] * n_channels
    if len(value) != n_channels:
        raise ValueError(f"{len(value)} values for {n_channels} channels")
    return list(value)
