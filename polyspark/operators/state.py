"""The global map: adjacency, attachment of ends, and ordered merging into versions of lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.operators.linemap import ATTACH_RADIUS, Line, LineMap
from polyspark.operators.stages import settled

POINTS = "array<struct<x:double,y:double>>"
#: Points of versions that a task hands on at once.
FRAME_POINTS = 50_000
#: Ends for which one look into cells of the radius' size will do.
FEW_ENDS = 1000


def _nine() -> Column:
    """The cells around one, as an array of steps."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def adjacent(patches: DataFrame, lines: DataFrame, radius: float, on: list[str] = [], alive: Column | None = None) -> DataFrame:  # noqa: B006
    """``token, line``: lines with a vertex within ``radius`` of the patch centre (``x, y``).

    Vertices are dealt to grid cells of the radius' size and each patch looks into nine: an equi-join with a residual. Columns ``on``
    must be equal as well, and ``alive`` must hold of a patch and a line.
    """
    dots = lines.drop("token").withColumn("p", F.explode("points")).withColumns({"cx": _cell(F.col("p.x"), radius), "cy": _cell(F.col("p.y"), radius)})
    looks = patches.withColumn("d", F.explode(_nine()))
    looks = looks.withColumns({"cx": _cell(F.col("x"), radius) + F.col("d.i"), "cy": _cell(F.col("y"), radius) + F.col("d.j")})
    hit = g.distance(F.col("p"), F.struct("x", "y")) <= radius
    both = looks.join(dots, [*on, "cx", "cy"]).filter(hit if alive is None else hit & alive)
    return both.select("token", "line").distinct()


def in_source_window(patches: DataFrame, lines: DataFrame, margin: float, on: list[str] = [], alive: Column | None = None, cell: float = 512.0) -> DataFrame:  # noqa: B006
    """``token, line``: lines of the patch's original image with a source pixel in its crop widened by ``margin``.

    A band join by cells of source pixels: a crop is dealt to the cells that it touches, a vertex to its own. Patches have
    ``x_min, y_min, x_max, y_max, original_image``, lines ``source_points, source_image``.
    """
    low = lambda c: F.col(f"{c}_min") - margin
    high = lambda c: F.col(f"{c}_max") + margin
    span = lambda c: F.sequence(_cell(low(c), cell), _cell(high(c), cell))
    looks = patches.filter("original_image <> '' AND x_min <= x_max AND y_min <= y_max").withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    dots = lines.drop("token").filter("source_image <> ''").withColumn("q", F.explode("source_points"))
    dots = dots.withColumns({"cx": _cell(F.col("q.x"), cell), "cy": _cell(F.col("q.y"), cell), "original_image": F.col("source_image")})
    hit = F.col("q.x").between(low("x"), high("x")) & F.col("q.y").between(low("y"), high("y"))
    both = looks.join(dots, [*on, "original_image", "cx", "cy"]).filter(hit if alive is None else hit & alive)
    return both.select("token", "line").distinct()


def near_patch(patches: DataFrame, lines: DataFrame, margin: float = 96.0, radius: float = 96.0, on: list[str] = [], alive: Column | None = None) -> DataFrame:  # noqa: B006
    """``token, line``: lines in the patch's source window, or within ``radius`` metres of its centre."""
    return in_source_window(patches, lines, margin, on, alive).unionByName(adjacent(patches, lines, radius, on, alive)).distinct()


def nearest_end(new: DataFrame, base: DataFrame, radius: float) -> DataFrame:
    """For each new line the base line of its category and type whose end is nearest to one of its ends, within ``radius``.

    Of equal distances the first way (base end to new start, start to end, end to end, start to start), then the first base.
    The more ends there are, the smaller are the first cells: what a line finds within a cell's width is its nearest, and only lines
    that find nothing look again, twice as far.
    """
    new, base = (settled(df.select("line", "category", "line_type", F.array(F.get("points", F.lit(0)), F.element_at("points", -1)).alias("points")), "ends") for df in (new, base))
    rounds = max(1, ceil(log2(max(1, base.count() / FEW_ENDS)) / 2) + 1)
    out = None
    for k in reversed(range(rounds)):
        found = _nearest_within(new, base, radius / 2**k)
        if k:
            found = settled(found, "nearest")
            new = new.join(found.select("line"), "line", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_within(new: DataFrame, base: DataFrame, radius: float) -> DataFrame:
    """As ``nearest_end``, in one look into cells of the radius' size."""
    def ends(df: DataFrame, name: str) -> DataFrame:
        p = F.posexplode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1))).alias("side", "e")
        rows = df.select(F.col("line").alias(name), "category", "line_type", p)
        return rows.withColumns({"cx": _cell(F.col("e.x"), radius), "cy": _cell(F.col("e.y"), radius)})

    looks = ends(new, "line").withColumn("d", F.explode(_nine())).withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j")}).drop("d")
    looks = looks.withColumnsRenamed({"side": "s", "e": "o"})
    both = looks.join(ends(base, "base"), ["category", "line_type", "cx", "cy"]).withColumn("dist", g.distance(F.col("e"), F.col("o"))).filter(F.col("dist") <= radius)
    # ways in order: base last to new first, base first to new last, last to last, first to first
    way = F.when((F.col("side") == 1) & (F.col("s") == 0), 0).when((F.col("side") == 0) & (F.col("s") == 1), 1).when(F.col("side") == 1, 2).otherwise(3)
    best = F.min(F.struct("dist", "base", way.alias("way"))).alias("b")
    return both.groupBy("line").agg(best).select("line", "b.base", "b.way", "b.dist")


_VERSION = (
    "scene string, pos long, rank int, seq long, died long, category string, line_type string, start_type string, end_type string,"
    f" points {POINTS}, source_points {POINTS}, source_image string"
)
_KEY = ["scene", "category", "line_type"]


def as_array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], np.float64).reshape(-1, 2)


def as_points(array: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in array.tolist()]


def _row(key: tuple, line: Line, died: int | None) -> tuple:
    (scene, category, line_type), (pos, rank, seq) = key, line.order
    return (scene, pos, rank, seq, died, category, line_type, *line.kinds, as_points(line.points), line.extra.get("source_points"), line.extra.get("source_image"))


def _versions(radius: float, died: bool = True):
    columns = [c.split()[0] for c in _VERSION.replace(POINTS, "p").split(",")]

    def frames(key: tuple, lines: Iterable[tuple[Line, int | None]]) -> Iterator[pd.DataFrame]:
        """Rows of versions, no more points at once than ``FRAME_POINTS`` and one line have."""
        rows, points = [], 0
        for line, at in lines:
            rows.append(_row(key, line, at))
            points += len(line.points)
            if points > FRAME_POINTS:
                yield pd.DataFrame(rows, columns=columns).astype({"died": "Int64"})
                rows, points = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"died": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lines, seq = None, LineMap(radius), 0

        def merged(rows: Iterable) -> Iterator[tuple[Line, int | None]]:
            """Adds lines of one kind; what they take up."""
            nonlocal seq
            for r in rows:
                source = {} if r.source_image is None else {"source_points": r.source_points, "source_image": r.source_image}
                # repeated rows share a place, so a running number tells them apart
                seq += 1
                _, gone = lines.add(Line((int(r.pos), int(r.rank), seq), as_array(r.points), (r.start_type, r.end_type), source))
                if gone is not None and died:
                    yield gone, int(r.pos)

        for b in batches:
            for now, rows in groupby(b.itertuples(index=False), key=lambda r: (r.scene, r.category, r.line_type)):
                if now != key:
                    yield from frames(key, ((x, None) for x in lines.lines.values()))
                    key, lines = now, LineMap(radius)
                yield from frames(key, merged(rows))
        yield from frames(key, ((x, None) for x in lines.lines.values()))

    return run


def map_versions(lines: DataFrame, radius: float = ATTACH_RADIUS, died: bool = True) -> DataFrame:
    """Every version of every line of the growing map: ``pos, rank, seq`` of the new line that made it, ``died`` the patch at which another took it up.

    Lines (``scene, pos, rank, category, line_type, start_type, end_type, points`` in metres, and ``source_points, source_image``
    where there are any) are added in the order of ``pos, rank``. Only lines of one category and type ever meet, so each kind of a
    scene is merged by itself; rows are streamed in order and a task holds one kind's live lines, not its input. A line that
    took up another one has no source pixels. Without ``died`` only the versions that nothing took up come out: the points of all versions
    of a line that grows are as many as the square of its own.
    """
    for c, kind in (("source_points", POINTS), ("source_image", "string")):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast(kind))
    rows = lines.select(
        F.col("scene").cast("string").alias("scene"), F.col("pos").cast("long").alias("pos"), F.col("rank").cast("int").alias("rank"),
        F.coalesce("category", F.lit("")).alias("category"), F.coalesce("line_type", F.lit("")).alias("line_type"), "start_type", "end_type", "points", "source_points", "source_image",
    )
    rows = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "pos", "rank")
    return rows.mapInPandas(_versions(radius, died), _VERSION)


def merge_maps(lines: DataFrame, radius: float = ATTACH_RADIUS) -> DataFrame:
    """The merged map of every scene: the versions that nothing took up, numbered in their order."""
    alive = map_versions(lines, radius, died=False)
    number = F.row_number().over(Window.partitionBy("scene").orderBy("pos", "rank", "seq")) - 1
    return alive.select("scene", number.alias("line_no"), "category", "line_type", "start_type", "end_type", "points")
