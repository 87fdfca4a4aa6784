"""Column expressions for points: distances, frames, tubes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two aliased points; one operand order everywhere, so boundary rounding agrees."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def frame(direction: Sequence[float]) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """An orthonormal frame (d, u, v) along a direction; the helper axis is x unless the direction is close to it."""

    def cross(p: Sequence[float], q: Sequence[float]) -> tuple[float, ...]:
        return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]

    def unit(p: Sequence[float]) -> tuple[float, ...]:
        n = math.sqrt(sum(c * c for c in p))
        return tuple(c / n for c in p)

    d = unit(direction)
    u = unit(cross(d, (1.0, 0.0, 0.0) if abs(d[0]) < 0.9 else (0.0, 1.0, 0.0)))
    return d, u, cross(d, u)


def frame_columns(direction: Sequence[Column]) -> tuple[list[Column], list[Column], list[Column]]:
    """``frame`` of a direction that is given by columns."""

    def cross(p: Sequence, q: Sequence) -> list[Column]:
        return [p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)]

    def unit(p: Sequence[Column]) -> list[Column]:
        n = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
        return [c / n for c in p]

    d = unit(direction)
    steep = F.abs(d[0]) < 0.9
    u = unit(cross(d, [F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0)]))
    return d, u, cross(d, u)


def tube_point(t: Column, angle: Column, radius: float | Column, d: Sequence, u: Sequence, v: Sequence, origin: Sequence = (0.0, 0.0, 0.0)) -> list[Column]:
    """x, y, z on a cylinder: along the axis by t, around it by the angle. Vectors may hold numbers or columns."""
    lift = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return [
        (lift(origin[i]) + t * lift(d[i]) + lift(radius) * (F.cos(angle) * lift(u[i]) + F.sin(angle) * lift(v[i]))).alias(AXES[i])
        for i in range(3)
    ]
