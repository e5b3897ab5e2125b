"""The projection of lines into patches, for the rows of an Arrow batch at once; polylines are flat arrays of vertices and offsets."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa

#: Vertices of densified lines that a task holds at once, and one line's more.
DENSE_POINTS = 1 << 18
THIN = 1e-3
KEPT = ("token", "ord", "category", "line_type")
FLAGS = ("before", "after", "at_start", "at_end")
BOX = ("x", "y", "x_min", "y_min", "x_max", "y_max", "ratio_x", "ratio_y", "middle_x", "middle_y")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vertices (rows of x and y, not a number where null) and the offsets of a column of polylines; a null one has none."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    xy = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in column.flatten().flatten()]
    return np.stack(xy, 1).reshape(-1, 2), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def nested(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The way back, without nulls."""
    xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), xy)


def parts_of(points: np.ndarray, offsets: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Into how many parts each segment is cut, by the ``step`` of its row: at least one, and one for the last vertex of a row."""
    sizes = np.diff(offsets)
    gap = np.zeros((len(points), 2))
    with np.errstate(over="ignore", invalid="ignore"):
        gap[:-1] = points[:-1] - points[1:]
        n = np.ceil(np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]) / np.repeat(step, sizes))
    n = np.where(np.isfinite(n), np.maximum(n, 1), 1).astype(np.int64)
    n[offsets[1:][sizes > 0] - 1] = 1
    return n


def densify(points: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts segments into ``n`` equal parts; as ``geometry.densify``."""
    start = np.concatenate([[0], np.cumsum(n)])
    which = np.repeat(np.arange(len(points)), n)
    k = (np.arange(start[-1]) - start[:-1][which])[:, None]
    step = np.zeros_like(points)
    with np.errstate(invalid="ignore"):
        step[:-1] = points[1:] - points[:-1]
        step[offsets[1:][np.diff(offsets) > 0] - 1] = 0.0
        return points[which] + step[which] * k / n[which][:, None], start[offsets]


def thin(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without vertices within ``THIN`` of the last kept one; as ``geometry.thin``."""
    first = np.zeros(len(points), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    # a vertex at the place of the one before goes, whether that one stays or not
    keep = first.copy()
    keep[1:] |= (points[1:] != points[:-1]).any(1)
    at = np.flatnonzero(keep)
    gap = points[at[1:]] - points[at[:-1]]
    close = (np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]) <= THIN) & ~first[at[1:]]
    for row in np.unique(np.searchsorted(offsets, at[1:][close], "right") - 1):
        last = None
        for i in range(offsets[row], offsets[row + 1]):
            x, y = points[i].tolist()
            keep[i] = last is None or sqrt((last[0] - x) * (last[0] - x) + (last[1] - y) * (last[1] - y)) > THIN
            if keep[i]:
                last = x, y
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _chunks(offsets: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``DENSE_POINTS`` densified vertices each."""
    ends = np.concatenate([[0], np.cumsum(n)])[offsets]
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + DENSE_POINTS, "right")) - 1)
        yield a, b
        a = b


def projector(size: int, metres: float, overlap: float, border: float):
    """Arrow batches of pairs to batches of ``token, ord, category, line_type, before, after, at_start, at_end, points``.

    Rows have ``same`` (whether ``points`` are source pixels), ``step``, the patch's centre, crop and image ratios and middles. A line is
    densified; the run from its first to its last vertex in the widened window, with two more on each side, is clamped and thinned.
    """
    hi, m, scale = float(size - 1), overlap, max(metres, 1e-6)

    def on_border(p: np.ndarray) -> np.ndarray:
        return ((p <= border) | (p >= size - 1 - border)).any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (*BOX, "step")}
            same = batch.column("same").to_numpy(zero_copy_only=False).astype(bool)
            every, offsets = flat(batch.column("points"))
            n = parts_of(every, offsets, number["step"])
            for a, b in _chunks(offsets, n):
                s, e = offsets[a], offsets[b]
                points, ends = densify(every[s:e], offsets[a : b + 1] - s, n[s:e])
                of = np.repeat(np.arange(a, b), np.diff(ends))
                x, y = points.T
                at = {c: v[of] for c, v in number.items() if c != "step"}
                with np.errstate(invalid="ignore"):
                    crop = np.stack([(x - at["x_min"]) * at["ratio_x"], (y - at["y_min"]) * at["ratio_y"]], 1)
                    far = np.stack([((x - at["x"]) / scale + at["middle_x"]) * at["ratio_x"], (at["middle_y"] - (y - at["y"]) / scale) * at["ratio_y"]], 1)
                    in_crop = (x >= at["x_min"] - m) & (x <= at["x_max"] + m) & (y >= at["y_min"] - m) & (y <= at["y_max"] + m)
                    in_window = ((far >= -m) & (far <= hi + m)).all(1)
                inside = np.flatnonzero(np.where(same[of], in_crop, in_window))
                rows, first = np.unique(of[inside], return_index=True)
                if not len(rows):
                    continue
                last = inside[np.append(first[1:], len(inside)) - 1]
                low, high = ends[rows - a], ends[rows - a + 1] - 1
                start, end = np.maximum(inside[first] - 2, low), np.minimum(last + 2, high)
                cut = np.concatenate([[0], np.cumsum(end - start + 1)])
                pick = np.arange(cut[-1]) + np.repeat(start - cut[:-1], end - start + 1)
                pixels = np.where(same[of[pick]][:, None], crop[pick], far[pick])
                kept, cut = thin(np.fmax(0.0, np.fmin(hi, pixels)), cut)
                whole = [batch.column(c).take(pa.array(rows)) for c in KEPT]
                flags = [start > low, end < high, on_border(kept[cut[:-1]]), on_border(kept[cut[1:] - 1])]
                yield pa.RecordBatch.from_arrays([*whole, *map(pa.array, flags), nested(kept, cut)], [*KEPT, *FLAGS, "points"])

    return run
