"""Settings of a project: defaults, a JSON or YAML file over them, and paths resolved against the file's folder."""

from __future__ import annotations

import copy
import json
import os

#: What a project has unless its file says otherwise.
DEFAULTS = {
    "project_root": ".", "data_dir": "data", "artifacts_dir": "artifacts", "video_dir": "data/video", "label_dir": "data/label",
    "identity_overrides": {"videos": {}, "labels": {}}, "class_names": {0: "Harmonic0"}, "seed": 42,
    "split": {"train": 0.7, "val": 0.15, "test": 0.15, "minimum_cases": 3, "segment_holdout": {"train": [], "val": [], "test": []}},
    "tracking": {"iou_threshold": 0.25, "maximum_age_frames": 15, "maximum_detections_per_frame": 20},
    "metrics": {"target_class": "Harmonic0", "confidence_threshold": 0.53, "center_radius": 0.2, "maximum_interpolation_gap_seconds": 0.6, "smoothing_window_seconds": 0.6},
    "ratings": {"bootstrap_iterations": 2000},
}
FOLDERS = ("data_dir", "artifacts_dir", "video_dir", "label_dir")


def load(path: str | None = None) -> dict:
    """The project's settings. Sections of the file are laid over the defaults key by key; folders become absolute, class ids numbers."""
    given, base = {}, os.getcwd()
    if path:
        base = os.path.dirname(os.path.abspath(path))
        with open(path, encoding="utf-8") as f:
            given = json.load(f) if path.endswith(".json") else _yaml(f.read())
    out = _over(copy.deepcopy(DEFAULTS), given)
    out["project_root"] = os.path.normpath(os.path.join(base, out["project_root"]))
    for key in FOLDERS:
        out[key] = os.path.normpath(os.path.join(out["project_root"], out[key]))
    out["class_names"] = {int(k): str(v) for k, v in out["class_names"].items()}
    return out


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("a YAML file needs the yaml package; JSON does not") from e
    return yaml.safe_load(text) or {}


def _over(base: dict, given: dict) -> dict:
    """``given`` over ``base``; maps of names (class_names, overrides, segment lists) are taken whole."""
    for key, value in given.items():
        nested = isinstance(value, dict) and isinstance(base.get(key), dict) and key not in ("class_names", "segment_holdout", "videos", "labels")
        base[key] = _over(base[key], value) if nested else value
    return base
