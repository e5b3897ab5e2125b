"""Polyline functions over ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` columns, as built-in higher-order functions.

A null polyline gives null; points with a null coordinate should be dropped first (``valid_points``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
#: Chamfer distance where either side has no points.
FAR = 1e6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def valid_points(points: Column) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    return F.filter(points, lambda p: ok(p["x"]) & ok(p["y"]))


def segments(points: Column) -> Column:
    """Lengths of the segments."""
    return F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: distance(p, F.get(points, i)))


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda s, x: s + x)


def cumulative(points: Column) -> Column:
    """Arc length at each vertex."""
    add = lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x)
    return F.aggregate(segments(points), F.array(F.lit(0.0)), add)


def at_arc(points: Column, cum: Column, t: Column) -> Column:
    """The point at arc length ``t``: in the segment of the last vertex at or before it."""
    k = F.greatest(F.lit(0), F.least(F.size(F.filter(cum, lambda c: c <= t)) - 1, F.size(cum) - 2))

    def inside(i: Column) -> Column:
        a, b, start = F.get(points, i), F.get(points, i + 1), F.get(cum, i)
        span = F.get(cum, i + 1) - start
        r = F.when(span > 0, (t - start) / span).otherwise(0.0)
        return point(a["x"] + r * (b["x"] - a["x"]), a["y"] + r * (b["y"] - a["y"]))

    return let(k, inside)


def resample(points: Column, interval: float, max_points: int) -> Column:
    """Equally spaced points, ``floor(length / interval) + 1`` of them, 2 at least and ``max_points`` at most.

    A line without length gives its first point; one point or none stays.
    """

    def spread(cum: Column) -> Column:
        total = F.element_at(cum, -1)
        n = F.least(F.greatest(F.floor(total / interval) + 1, F.lit(2)), F.lit(max_points)).cast("int")
        step = total / (n - 1)
        even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at_arc(points, cum, F.when(i == n - 1, total).otherwise(i * step)))
        return F.when(total < 1e-6, F.slice(points, 1, 1)).otherwise(even)

    return F.when(F.size(points) <= 1, points).otherwise(let(cumulative(points), spread))


def densify(points: Column, step: float) -> Column:
    """Cuts every segment into ``ceil(length / step)`` equal parts."""
    step = max(step, 1e-3)

    def cut(p: Column, i: Column) -> Column:
        q = F.get(points, i + 1)
        n = F.greatest(F.ceil(distance(p, q) / step), F.lit(1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: point(p["x"] + (q["x"] - p["x"]) * k / n, p["y"] + (q["y"] - p["y"]) * k / n))
        return F.when(q.isNull(), F.array(p)).otherwise(parts)

    return F.when(F.size(points) <= 1, points).otherwise(F.flatten(F.transform(points, cut)))


def world_to_pixel(points: Column, size: int, half: float = 30.0) -> Column:
    k = (size - 1) / (2 * half)
    return F.transform(points, lambda p: point((p["x"] + half) * k, (half - p["y"]) * k))


def pixel_to_world(points: Column, size: int, half: float = 30.0) -> Column:
    k = 2 * half / (size - 1)
    return F.transform(points, lambda p: point(p["x"] * k - half, half - p["y"] * k))


def clip(points: Column, low: float, high: float) -> Column:
    fit = lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v))
    return F.transform(points, lambda p: point(fit(p["x"]), fit(p["y"])))


def scale(points: Column, kx: Column, ky: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] * kx, p["y"] * ky))


def on_border(p: Column, size: int, tol: float) -> Column:
    return (p["x"] <= tol) | (p["y"] <= tol) | (p["x"] >= size - 1 - tol) | (p["y"] >= size - 1 - tol)


def border_tolerance(size: int) -> float:
    return max(2.0, 0.02 * size)


def end_types(points: Column, size: int) -> tuple[Column, Column]:
    """``cut`` where the line starts or ends at the border, else ``start`` and ``end``."""
    tol = border_tolerance(size)
    return (
        F.when(on_border(F.get(points, F.lit(0)), size, tol), "cut").otherwise("start"),
        F.when(on_border(F.element_at(points, -1), size, tol), "cut").otherwise("end"),
    )


def rotate(points: Column, degrees: Column, cx: float, cy: float) -> Column:
    def turn(a: Column) -> Column:
        c, s = F.cos(a), F.sin(a)
        return F.transform(points, lambda p: point(cx + (p["x"] - cx) * c - (p["y"] - cy) * s, cy + (p["x"] - cx) * s + (p["y"] - cy) * c))

    return let(F.radians(degrees), turn)


def quarter_turns(points: Column, k: Column, size: int) -> Column:
    """``k`` quarter turns, counter-clockwise on screen, of pixels in a square image."""
    m = float(size - 1)
    turn = lambda p: F.when(k == 1, point(p["y"], m - p["x"])).when(k == 2, point(m - p["x"], m - p["y"])).when(k == 3, point(m - p["y"], p["x"])).otherwise(p)
    return F.transform(points, turn)


def flip(points: Column, horizontal: Column, vertical: Column, size: int) -> Column:
    m = float(size - 1)
    return F.transform(points, lambda p: point(F.when(horizontal, m - p["x"]).otherwise(p["x"]), F.when(vertical, m - p["y"]).otherwise(p["y"])))


def inside_then_clamp(points: Column, patch: float, margin: float) -> Column:
    """Points of the patch widened by ``margin``, clamped to the patch; edges are not cut."""
    ok = lambda v: (v >= -margin) & (v <= patch + margin)
    return clip(F.filter(points, lambda p: ok(p["x"]) & ok(p["y"])), 0.0, patch)


def thin(points: Column, tol: float = 1e-3) -> Column:
    """Without vertices within ``tol`` of the last kept one."""
    start = F.slice(points, 1, 1)
    step = lambda kept, p: F.when(distance(F.element_at(kept, -1), p) > tol, F.array_append(kept, p)).otherwise(kept)
    return F.when(F.size(points) < 2, points).otherwise(F.aggregate(F.slice(points, F.lit(2), F.size(points)), start, step))


def yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def local_to_global(points: Column, angle: Column, tx: Column, ty: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(points, lambda p: point(p["x"] * c - p["y"] * s + tx, p["x"] * s + p["y"] * c + ty))


def global_to_local(points: Column, angle: Column, tx: Column, ty: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(points, lambda p: point((p["x"] - tx) * c + (p["y"] - ty) * s, (p["y"] - ty) * c - (p["x"] - tx) * s))


def one_way(a: Column, b: Column) -> Column:
    """Mean distance from the vertices of ``a`` to their nearest vertex of ``b``."""
    nearest = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: distance(p, q))))
    return F.aggregate(nearest, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(a))


def chamfer(a: Column, b: Column) -> Column:
    """Mean of the two one-way distances; ``FAR`` where a side has no points."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(FAR)).otherwise((one_way(a, b) + one_way(b, a)) / 2)


def signature(category: Column, line_type: Column, points: Column, cell: float) -> Column:
    """Equal for lines of one kind with the same pair of rounded ends and as many vertices."""
    at = lambda p: F.struct(F.rint(p["x"] / cell).cast("int").alias("x"), F.rint(p["y"] / cell).cast("int").alias("y"))
    a, b = at(F.get(points, F.lit(0))), at(F.element_at(points, -1))
    return F.struct(category.alias("category"), line_type.alias("line_type"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.size(points).alias("n"))
