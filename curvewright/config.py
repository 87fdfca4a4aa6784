"""Settings of the extraction, with their checks, and the flat form that requests use."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

MODES = ("none", "surface", "collapse", "auto")
METHODS = ("radius", "knn", "mst")


@dataclass(frozen=True)
class NeighborConfig:
    """How the adjacency graph is built. ``scale`` None: the estimated pitch."""

    method: str = "radius"
    scale: float | None = None
    radius_factor: float = 1.6
    k: int = 10
    prune_shortcuts: bool = True

    def check(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown neighbour method {self.method!r}; choose one of {METHODS}")


@dataclass(frozen=True)
class ReduceConfig:
    """How thick clouds are thinned. ``collapse_radius`` and ``axis_hint`` are accepted and have no effect."""

    mode: str = "none"
    scale: float | None = None
    collapse_radius: float = math.inf
    contraction_iterations: int = 10
    contraction_neighbor_factor: float = 2.5
    wl_init: float | None = None
    sl: float = 1.6
    wh: float = 1.0
    boundary_anchor: float = 8.0
    merge_factor: float = 0.5
    axis_hint: Sequence[float] | None = None

    def check(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown reduce mode {self.mode!r}; choose one of {MODES}")


@dataclass(frozen=True)
class Config:
    reduce: ReduceConfig = field(default_factory=ReduceConfig)
    neighbors: NeighborConfig = field(default_factory=NeighborConfig)
    min_stub_points: int = 0
    junction_merge_factor: float = 2.0

    def check(self) -> Config:
        self.reduce.check()
        self.neighbors.check()
        return self


def clean_config(flat: Mapping[str, Any]) -> dict[str, Any]:
    """Drop ``*.scale`` entries that are zero, empty or None: they mean automatic."""
    return {k: v for k, v in flat.items() if not (k.endswith(".scale") and v in (0, "", None))}


def build_config(flat: Mapping[str, Any] | None) -> Config:
    """A Config from dotted keys; unknown keys are ignored."""
    known = {"reduce": ReduceConfig, "neighbors": NeighborConfig}
    own = {f.name for f in fields(Config)} - known.keys()
    made: dict[str, dict[str, Any]] = {k: {} for k in known}
    top = {}
    for key, value in (flat or {}).items():
        group, _, name = key.rpartition(".")
        if group in known and name in {f.name for f in fields(known[group])}:
            made[group][name] = value
        elif not group and name in own:
            top[name] = value
    return Config(**{k: cls(**made[k]) for k, cls in known.items()}, **top)


def parameter(name: str, default: float, low: float, high: float, step: float, label: str) -> dict[str, Any]:
    """A descriptor; whole numbers throughout make it an integer."""
    kind = "int" if all(isinstance(v, int) for v in (default, low, high, step)) else "float"
    return {"name": name, "type": kind, "default": default, "min": low, "max": high, "step": step, "label": label}


def config_schema() -> list[dict[str, Any]]:
    """The parameters that a front end may show, with ranges (fixed values)."""
    return [
        {"group": "Reduction", "params": [
            {"name": "reduce.mode", "type": "enum", "default": "none", "options": list(MODES), "label": "Mode"},
            parameter("reduce.scale", 0.0, 0.0, 5.0, 0.05, "Scale (0: automatic)"),
            parameter("reduce.contraction_iterations", 10, 0, 30, 1, "Contraction iterations"),
            parameter("reduce.contraction_neighbor_factor", 2.5, 1.0, 5.0, 0.1, "Contraction radius factor"),
            parameter("reduce.merge_factor", 0.5, 0.1, 1.0, 0.05, "Edge collapse factor"),
            parameter("reduce.boundary_anchor", 8.0, 0.0, 20.0, 1.0, "Boundary anchor (0: off)"),
        ]},
        {"group": "Adjacency", "params": [
            {"name": "neighbors.method", "type": "enum", "default": "radius", "options": list(METHODS), "label": "Method"},
            parameter("neighbors.radius_factor", 1.6, 1.0, 3.0, 0.05, "Radius factor"),
            parameter("neighbors.k", 10, 2, 20, 1, "k (knn, mst)"),
            {"name": "neighbors.prune_shortcuts", "type": "bool", "default": True, "label": "Prune shortcut edges"},
        ]},
        {"group": "Cleanup", "params": [
            parameter("junction_merge_factor", 2.0, 0.0, 5.0, 0.25, "Junction merge factor (0: off)"),
            parameter("min_stub_points", 0, 0, 20, 1, "Prune stubs shorter than (0: off)"),
        ]},
    ]
