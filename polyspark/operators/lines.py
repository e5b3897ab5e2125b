"""From raw annotations to serialized lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.functions import text


def serialize(
    lines: DataFrame,
    size: int = 224,
    interval: float = 6.0,
    max_points: int = 24,
    max_lines: int = 48,
    half: float = 30.0,
    categories: tuple[str, ...] = text.CATEGORIES,
) -> DataFrame:
    """``token, rank, category, line_type, start_type, end_type, points`` (pixels) of ``token, line_idx, category, line_type, points`` (metres).

    Lines of other categories or with fewer than two usable points go. Lines of a token are ranked by the distance of
    their first point to the top left corner, then by ``line_idx``; the first ``max_lines`` stay.
    """
    rows = lines.withColumns({"category": text.category(F.col("category")), "line_type": text.line_type(F.col("line_type")), "points": g.valid_points(F.col("points"))})
    rows = rows.filter(F.col("category").isin(*categories) & (F.size("points") >= 2))
    rows = rows.withColumn("points", g.world_to_pixel(g.resample(F.col("points"), interval, max_points), size, half))
    # a generator of one row: what is computed from the points would else repeat all that made them
    rows = rows.select("token", "line_idx", "category", "line_type", F.inline(F.array(F.struct("points"))))
    start, end = g.end_types(F.col("points"), size)
    first = F.get("points", F.lit(0))
    norm = F.sqrt(first["x"] * first["x"] + first["y"] * first["y"])
    rank = F.row_number().over(Window.partitionBy("token").orderBy(norm, "line_idx"))
    return rows.select("token", rank.alias("rank"), "category", "line_type", start.alias("start_type"), end.alias("end_type"), "points").filter(F.col("rank") <= max_lines)


def serialize_pixels(lines: DataFrame, size: int, metres_per_pixel: float = 0.15, interval: float = 6.0, max_points: int = 24, max_lines: int = 48, categories: tuple[str, ...] = text.CATEGORIES) -> DataFrame:
    """As ``serialize`` for pixel lines with ``image_width`` and ``image_height``: rescaled, then resampled; lines that collapse to one point go."""
    rows = lines.withColumns({"category": text.category(F.col("category")), "line_type": text.line_type(F.col("line_type")), "points": g.valid_points(F.col("points"))})
    rows = rows.filter(F.col("category").isin(*categories) & (F.size("points") >= 2))
    k = lambda c: F.lit(float(size - 1)) / F.greatest(F.coalesce(F.col(c), F.lit(4096)) - 1, F.lit(1))
    points = g.resample(g.scale(F.col("points"), k("image_width"), k("image_height")), interval / metres_per_pixel, max_points)
    rows = rows.select("token", "line_idx", "category", "line_type", F.inline(F.array(F.struct(points.alias("points"))))).filter(F.size("points") >= 2)
    start, end = g.end_types(F.col("points"), size)
    first = F.get("points", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.sqrt(first["x"] * first["x"] + first["y"] * first["y"]), "line_idx"))
    return rows.select("token", rank.alias("rank"), "category", "line_type", start.alias("start_type"), end.alias("end_type"), "points").filter(F.col("rank") <= max_lines)


def longest(lines: DataFrame, key: str = "token", order: str = "line_idx") -> DataFrame:
    """The longest line of each key; of equal ones the first."""
    rows = lines.withColumn("length", g.length(F.col("points")))
    best = F.max_by(F.struct(order, "length"), F.struct("length", (-F.col(order)).alias("o")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, f"b.{order}", "b.length")


def dedup_signature(lines: DataFrame, order: list[str], cell: float = 1.0) -> DataFrame:
    """The first line of each signature."""
    rows = lines.withColumn("sig", g.signature(F.col("category"), F.col("line_type"), F.col("points"), cell))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("sig").orderBy(*order))).filter("n = 1").drop("sig", "n")
