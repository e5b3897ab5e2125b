"""Scanning frames in their own coordinates: the map of the frames before, seen from each frame."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.operators import state
from polyspark.operators.stages import settled

HALF = 30.0
LINE = ("category", "line_type")


def to_world(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines in metres about a frame (``token, rank, category, line_type, points``) as ``scene, pos, rank, ..., points`` in world metres."""
    rows = lines.join(frames.select("token", "scene", "pos", "x", "y", "yaw"), "token").filter(F.size("points") > 0)
    moved = g.local_to_global(F.col("points"), F.col("yaw"), F.col("x"), F.col("y"))
    return rows.select("scene", "pos", "rank", *LINE, moved.alias("points"))


def first_seen(world: DataFrame, cell: float = 1.0) -> DataFrame:
    """The first line of each signature of a scene, in the order of ``pos`` and ``rank``: this map only grows, nothing is joined.

    One aggregation: the earliest row of a signature comes with its line, so no group is gathered.
    """
    rows = world.withColumn("sign", g.signature(F.col("category"), F.col("line_type"), F.col("points"), cell))
    first = F.min_by(F.struct("pos", "rank", *LINE, "points"), F.struct("pos", "rank")).alias("l")
    return rows.groupBy("scene", "sign").agg(first).select("scene", "l.*")


def in_frame(points: Column, half: float = HALF) -> Column:
    """Points of the frame's window; edges are not cut."""
    return F.filter(points, lambda p: (F.abs(p["x"]) <= half) & (F.abs(p["y"]) <= half))


def seen_before(frames: DataFrame, known: DataFrame, size: int = 224, max_lines: int = 48, half: float = HALF) -> DataFrame:
    """``token, rank, category, line_type, start_type, end_type, points`` (pixels): what each frame sees of the lines of earlier frames.

    Lines are met by grid cells around the frame's centre, then turned into its coordinates; those with two points in the
    window stay, the first ``max_lines`` in the order in which they came. So the map is looked at by age: the oldest lines of
    a scene first, and the rest only by frames that have not found enough and came after them.
    """
    frames, known = settled(frames.select("token", "scene", "pos", "x", "y", "yaw"), "frames"), settled(known, "known")
    ages = [a for a in _ages(known, max_lines) if a < 1.0]
    oldest = known.groupBy("scene").agg(F.percentile_approx("pos", F.array(*map(F.lit, ages)), 10_000).alias("until")) if ages else None
    ranges = oldest and settled(oldest, "ages")
    found, after = None, None
    for n in range(len(ages) + 1):
        lines, look = known, frames
        if ranges is not None:
            low = F.get("until", F.lit(n - 1)) if n else F.lit(None)
            high = F.get("until", F.lit(n)) if n < len(ages) else F.lit(None)
            bounds = F.broadcast(ranges.select("scene", low.cast("long").alias("low"), high.cast("long").alias("high")))
            lines = known.join(bounds, "scene").filter("(low IS NULL OR pos > low) AND (high IS NULL OR pos <= high)").drop("low", "high")
            look = (after if n else frames).join(bounds, "scene").filter("low IS NULL OR pos > low").drop("low", "high")
        rows = settled(_shown(look, lines, size, max_lines, half), "seen")
        found = rows if found is None else found.unionByName(rows)
        full = found.groupBy("token").count().filter(F.col("count") >= max_lines).select("token")
        after = look.join(full, "token", "left_anti")
    rank = F.row_number().over(Window.partitionBy("token").orderBy("born", "nth", *LINE))
    start, end = g.end_types(F.col("points"), size)
    return found.select("token", rank.alias("rank"), *LINE, start.alias("start_type"), end.alias("end_type"), "points").filter(F.col("rank") <= max_lines)


def _ages(known: DataFrame, max_lines: int) -> list[float]:
    """Shares of a scene's lines, each eight times the one before; the first holds a few times what a frame shows."""
    rows, scenes = known.agg(F.count("*"), F.count_distinct("scene")).first()
    share, out = 4.0 * max_lines * max(1, scenes) / max(1, rows), []
    while share < 1.0:
        out.append(share)
        share *= 8
    return out


def _shown(frames: DataFrame, known: DataFrame, size: int, max_lines: int, half: float) -> DataFrame:
    """``token, born, nth, category, line_type, points`` (pixels): the first ``max_lines`` of the lines that each frame sees."""
    lines = known.withColumn("line", F.struct("scene", *LINE, "pos", "rank")).withColumnsRenamed({"pos": "born", "rank": "nth"})
    near = state.adjacent(frames.select("token", "scene", "pos", "x", "y"), lines, half * sqrt(2), ["scene"], F.col("born") < F.col("pos"))
    rows = near.join(frames.select("token", "x", "y", "yaw"), "token").join(lines.drop("scene"), "line")
    local = in_frame(g.global_to_local(F.col("points"), F.col("yaw"), F.col("x"), F.col("y")), half)
    rows = rows.select("token", "born", "nth", *LINE, F.inline(F.array(F.struct(local.alias("local"))))).filter(F.size("local") >= 2)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("born", "nth", *LINE))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= max_lines)
    return rows.select("token", "born", "nth", *LINE, g.world_to_pixel(F.col("local"), size, half).alias("points"))


def scan(frames: DataFrame, lines: DataFrame, size: int = 224, max_lines: int = 48, half: float = HALF) -> tuple[DataFrame, DataFrame]:
    """What each frame sees before its own lines are added, and the final map (``scene, pos, rank`` of the frame that brought a line)."""
    known = first_seen(to_world(lines, frames))
    return seen_before(frames, known, size, max_lines, half), known
