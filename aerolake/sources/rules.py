"""Rule layers: JSON files of limits, rules and bounds that a user puts over the library's own, small enough to be read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from aerolake.operators import responses


@dataclass
class Rules:
    """limits: axis: (min, max, ideal) of each of ``responses.METRICS``. rules: (symptom, metric, gain, factor). bounds: gain: (lowest, highest) by platform."""

    limits: dict[str, list[tuple]] = field(default_factory=lambda: dict(responses.LIMITS))
    rules: list[tuple] = field(default_factory=lambda: list(responses.RULES))
    bounds: dict[str, dict[str, tuple]] = field(default_factory=lambda: dict(responses.BOUNDS))
    skipped: list[str] = field(default_factory=list)


def merged(below: dict, above: dict) -> dict:
    """``above`` laid over ``below``, dictionaries key by key, everything else whole."""
    return below | {k: merged(below[k], v) if isinstance(v, dict) and isinstance(below.get(k), dict) else v for k, v in above.items()}


def read_layers(folders: Sequence[str]) -> tuple[dict, list[str]]:
    """All *.json files of the folders laid over one another, later folders and later names above; and the files that are no JSON object."""
    out, skipped = {}, []
    for folder in folders:
        for name in sorted(os.listdir(folder) if os.path.isdir(folder) else ()):
            if not name.endswith(".json"):
                continue
            path = os.path.join(folder, name)
            try:
                with open(path, encoding="utf-8") as file:
                    layer = json.load(file)
            except (OSError, ValueError):
                layer = None
            if isinstance(layer, dict):
                out = merged(out, layer)
            else:
                skipped.append(path)
    return out, skipped


def by_axis(thresholds: object) -> bool:
    """Whether limits have the form axis: metric: {max: number}; any other form is passed over for the library's own."""
    own = thresholds if isinstance(thresholds, dict) else {}
    return any(isinstance(m, dict) and isinstance(m.get("max"), (int, float)) for axis in ("roll", "pitch", "yaw") if isinstance(own.get(axis), dict) for m in own[axis].values())


def load(folders: Sequence[str]) -> Rules:
    """The library's rules with what the layers of the folders say, as far as it has the right form."""
    layers, skipped = read_layers(folders)
    out = Rules(skipped=skipped)
    if by_axis(layers.get("thresholds")):
        for axis, metrics in layers["thresholds"].items():
            if axis in out.limits and isinstance(metrics, dict):
                own = [metrics.get(name) if isinstance(metrics.get(name), dict) else {} for name in responses.METRICS]
                out.limits[axis] = [tuple(m.get(x, o) for x, o in zip(("min", "max", "ideal"), old, strict=True)) for m, old in zip(own, out.limits[axis], strict=True)]
    listed = layers.get("tuning_rules")
    if isinstance(listed, list):
        known = {s: m for s, m, _, _ in responses.RULES}
        taken = [(r["symptom"], known[r["symptom"]], r["gain"], float(r["factor"])) for r in listed if isinstance(r, dict) and r.get("symptom") in known and {"gain", "factor"} <= r.keys()]
        out.rules = taken or out.rules
    for platform, gains in (layers.get("pid_bounds") or {}).items() if isinstance(layers.get("pid_bounds"), dict) else ():
        if isinstance(gains, dict):
            out.bounds[platform] = out.bounds.get(platform, {}) | {g: tuple(map(float, b)) for g, b in gains.items() if isinstance(b, (list, tuple)) and len(b) == 2}
    return out
