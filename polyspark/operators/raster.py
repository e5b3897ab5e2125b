"""Pixels of lines as words of 64, from batches of segments.

A pixel belongs to a line if it is within half the stroke's width of one of its segments. What is near a segment is
convex, so its pixels in an image row are a run; both ends come in closed form and the distance itself decides about them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
SLACK = 1e-6
#: Rows of segments that are taken at once.
ROWS = 400_000


def _runs(p: np.ndarray, q: np.ndarray, half: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``segment, y, left, right`` of the runs of pixels of segments from ``p`` to ``q``."""
    low = np.maximum(0, np.ceil(np.minimum(p[:, 1], q[:, 1]) - half)).astype(np.int64)
    high = np.minimum(size - 1, np.floor(np.maximum(p[:, 1], q[:, 1]) + half)).astype(np.int64)
    n = np.maximum(0, high - low + 1)
    which = np.repeat(np.arange(len(p)), n)
    y = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
    (px, py), (qx, qy), half = p[which].T, q[which].T, half[which]
    dx, dy = qx - px, qy - py
    norm = dx * dx + dy * dy
    ends = []
    with np.errstate(all="ignore"):
        for ex, ey in ((px, py), (qx, qy)):
            reach = np.sqrt(np.maximum(0.0, half * half - (y - ey) ** 2))
            reach[np.abs(y - ey) > half + SLACK] = np.nan
            ends += [ex - reach, ex + reach]
        for sign in (1.0, -1.0):
            along = (y - py - sign * dx * half / np.sqrt(norm)) / dy
            x = px - sign * dy * half / np.sqrt(norm) + along * dx
            x[~((along >= -SLACK) & (along <= 1 + SLACK))] = np.nan
            ends.append(x)
        left = np.ceil(np.fmin.reduce(ends) - SLACK)
        right = np.floor(np.fmax.reduce(ends) + SLACK)
        left, right = np.maximum(0, left), np.minimum(size - 1, right)

        def near(x: np.ndarray) -> np.ndarray:
            t = np.clip(((x - px) * dx + (y - py) * dy) / norm, 0.0, 1.0)
            t = np.where(norm > 0, t, 0.0)
            return (px + t * dx - x) ** 2 + (py + t * dy - y) ** 2 <= half * half

        left = left + ~near(left)
        right = right - ~near(right)
        ok = left <= right
    return which[ok], y[ok], left[ok].astype(np.int64), right[ok].astype(np.int64)


def _words(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``run, word, bits`` of runs of pixels in a row."""
    n = right // WORD - left // WORD + 1
    which = np.repeat(np.arange(len(left)), n)
    word = left[which] // WORD + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.maximum(left[which], word * WORD) % WORD).astype(np.uint64)
    last = (np.minimum(right[which], word * WORD + WORD - 1) % WORD).astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return which, word, (full >> (np.uint64(63) - last + first)) << first


def line_words(points: list[np.ndarray], half: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line, word, bits`` of every word with a pixel, each once, ``half`` the reach of each line; word ``k`` of image row ``y`` is ``y * ceil(size / 64) + k``."""
    per_row = -(-size // WORD)
    keep = [k for k, x in enumerate(points) if len(x) > 1]
    if not keep:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = np.concatenate([points[k][:-1] for k in keep]), np.concatenate([points[k][1:] for k in keep])
    line = np.repeat(np.array(keep), [len(points[k]) - 1 for k in keep])
    finite = np.isfinite(p).all(axis=1) & np.isfinite(q).all(axis=1)
    p, q, line = p[finite], q[finite], line[finite]
    which, y, left, right = _runs(p, q, half[line], size)
    run, word, bits = _words(left, right)
    key = line[which[run]] * (per_row * size) + y[run] * per_row + word
    order = np.argsort(key, kind="stable")
    key, bits = key[order], bits[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(bits, start) if len(key) else bits
    return key[start] // (per_row * size), key[start] % (per_row * size), bits.view(np.int64)


def as_arrays(column: pa.Array) -> list[np.ndarray]:
    """The points of each list; a null list has none."""
    flat = column.flatten()
    xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y")])
    sizes = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return np.split(xy, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _map(keys: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, half = as_arrays(b.column("points")), b.column("__width").to_numpy() / 2
            # image rows that a line's segments may touch, to bound what is held
            cost = np.cumsum([min(len(x) * size, 1 + int(np.abs(np.diff(np.nan_to_num(x[:, 1]), axis=0)).sum() + len(x) * (2 * h + 2))) for x, h in zip(points, half)])
            start = 0
            while start < len(points):
                base = cost[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(cost, base + ROWS)))
                line, word, bits = line_words(points[start:stop], half[start:stop], size)
                which = pa.array(line + start)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(which) for k in keys), pa.array(word.astype(np.int32)), pa.array(bits)], [*keys, "word", "bits"])
                start = stop

    return run


def segment_words(lines: DataFrame, keys: list[str], width: float | Column, size: int) -> DataFrame:
    """``keys, word, bits``: the pixels within half a ``width`` (a number or a column) of each line of ``keys, points``; words of one line are united."""
    kind = {f.name: f.dataType.simpleString() for f in lines.select(*keys).schema}
    out = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    reach = width if isinstance(width, Column) else F.lit(float(width))
    return lines.select(*keys, "points", reach.cast("double").alias("__width")).mapInArrow(_map(keys, size), f"{out}, word int, bits long")
