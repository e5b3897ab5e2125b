"""Building an augmented dataset: matched patches, split and expanded, as five tables from one pass over the source.

Base patches are rows ``token, image_width, source_image, source_split, city, center_x, center_y`` (place in the source image),
``x_min, y_min, x_max, y_max, lon, lat`` and ``lines``, an array of ``category, line_type, points``. Raw images are rows
``source_image, raw_width, raw_height, raw_lines``; tile bounds are ``source_image`` with the ranges of both axes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.operators import snapshot
from polyspark.operators.stages import numbered, settled

MARGIN = 10.0
LINES = "array<struct<category:string,line_type:string,points:array<struct<x:double,y:double>>>>"
SPEC = "kind string, suffix string, dx int, dy int, crop_angle double, rotation double"


@dataclass(frozen=True)
class Augmentation:
    """Angles in degrees, offsets in pixels; zeros among them are left out."""

    rotations: tuple[float, ...] = (90.0, 180.0, 270.0)
    offsets: tuple[tuple[int, int], ...] = tuple((x, y) for x in (-448, 0, 448) for y in (-448, 0, 448))
    inclines: tuple[float, ...] = (-15.0, 15.0)

    def spec(self, spark: SparkSession) -> DataFrame:
        """``kind, suffix, dx, dy, crop_angle, rotation`` of everything that becomes of a patch: the product of crops and rotations."""
        turns = [(None, "")] + [(float(a), f"__rot{round(a):03d}") for a in self.rotations if abs(a) > 1e-6]
        crops = [("base", "", None, None, None)]
        crops += [("overlap", f"__ovp_x{x:+d}_y{y:+d}", x, y, None) for x, y in self.offsets if (x, y) != (0, 0)]
        crops += [("inclined", f"__inc_{round(a):03d}", None, None, float(a)) for a in self.inclines if abs(a) > 1e-6]
        name = lambda kind, turn: kind if turn is None else "rotation" if kind == "base" else f"{kind}_rotation"
        rows = [(name(kind, turn), s + t, x, y, a, turn) for kind, s, x, y, a in crops for turn, t in turns]
        return spark.createDataFrame(rows, SPEC)


def split_by_order(tokens: DataFrame, order: list, ratio: float) -> DataFrame:
    """Adds ``split``: of all tokens in order the last ``max(1, round(n * ratio))``, n - 1 at most, are ``val``. No window over all tokens."""
    rows = numbered(tokens, order, "__n")
    total = rows.agg(F.count("*").alias("__total"))
    val = F.least(F.greatest(F.rint(F.col("__total") * ratio), F.lit(1)), F.col("__total") - 1)
    rows = rows.crossJoin(F.broadcast(total))
    return rows.withColumn("split", F.when(F.col("__n") >= F.col("__total") - val, "val").otherwise("train")).drop("__n", "__total")


def _each(lines: Column, points) -> Column:
    """Lines with their points changed, without those that keep fewer than two."""
    moved = F.transform(lines, lambda x: F.struct(x["category"].alias("category"), x["line_type"].alias("line_type"), points(x["points"]).alias("points")))
    return F.filter(moved, lambda x: F.size(x["points"]) >= 2)


def _turned(lines: Column, degrees: Column, size: Column) -> Column:
    """Lines turned about the middle of a patch and clamped to it."""
    fit = lambda v: F.greatest(F.lit(0.0), F.least(size, v))

    def turn(points: Column) -> Column:
        c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        m = size * 0.5
        return F.transform(points, lambda p: g.point(fit(m + (p["x"] - m) * c - (p["y"] - m) * s), fit(m + (p["x"] - m) * s + (p["y"] - m) * c)))

    return _each(lines, turn)


def _cropped(lines: Column, cx: Column, cy: Column, degrees: Column, x_min: Column, y_min: Column, size: Column) -> Column:
    """Raw lines turned about the centre of a crop: points in the widened crop, clamped to it."""
    fit = lambda v: F.greatest(F.lit(0.0), F.least(size, v))
    ok = lambda v: (v >= -MARGIN) & (v <= size + MARGIN)

    def move(points: Column) -> Column:
        c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        local = F.transform(points, lambda p: g.point(cx + (p["x"] - cx) * c - (p["y"] - cy) * s - x_min, cy + (p["x"] - cx) * s + (p["y"] - cy) * c - y_min))
        return F.transform(F.filter(local, lambda p: ok(p["x"]) & ok(p["y"])), lambda p: g.point(fit(p["x"]), fit(p["y"])))

    return _each(F.filter(lines, lambda x: F.size(x["points"]) >= 2), move)


def tile_bounds(grid: DataFrame) -> DataFrame:
    """``source_image, lon_low, lon_high, lat_low, lat_high`` of tiles whose cell centres (``image, lon, lat``) are known."""
    axis = lambda c: snapshot.axis_bounds(grid.filter(F.col(c).isNotNull()), ["image"], c).select("image", F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    return axis("lon").join(axis("lat"), "image").withColumnRenamed("image", "source_image")


def pixel_to_gps(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel of a tile whose bounds are columns as in ``tile_bounds``."""
    along = lambda v, n: v.cast("double") / F.greatest(n - 1, F.lit(1))
    between = lambda c, t: F.col(f"{c}_low") + t * (F.col(f"{c}_high") - F.col(f"{c}_low"))
    return between("lon", along(x, width)), between("lat", 1.0 - along(y, height))


def _places(base: DataFrame, satellites: DataFrame, tiles: DataFrame, bounds: DataFrame, augmentation: Augmentation, order: list, ratio: float, augment_val: bool) -> DataFrame:
    """What ``places`` gives, with what the lines of a crop depend on: ``crop, cx, cy, size`` and the crop's ``left, top``."""
    spark = base.sparkSession
    split = split_by_order(base.join(satellites.select("token").distinct(), "token", "left_semi").select("token"), order, ratio)
    tiles = tiles.select("source_image", "raw_width", "raw_height", F.lit(True).alias("has_raw"))
    rows = base.join(split, "token").join(tiles, "source_image", "left").join(bounds, "source_image", "left")
    rows = rows.crossJoin(F.broadcast(augmentation.spec(spark)))
    crop = F.col("kind").startswith("overlap") | F.col("kind").startswith("inclined")
    rows = rows.filter((F.col("kind") == "base") | (F.col("split") == "train") | F.lit(augment_val)).filter(~crop | F.col("has_raw"))
    size = F.col("image_width").cast("double")
    cx, cy = F.coalesce("center_x", F.lit(0)) + F.coalesce("dx", F.lit(0)), F.coalesce("center_y", F.lit(0)) + F.coalesce("dy", F.lit(0))
    rows = rows.withColumns({"crop": crop, "cx": cx.cast("double"), "cy": cy.cast("double"), "size": size})
    rows = rows.withColumns({"left": F.rint(F.col("cx") - F.col("size") * 0.5).cast("int"), "top": F.rint(F.col("cy") - F.col("size") * 0.5).cast("int")})
    right, bottom = F.col("left") + F.col("image_width"), F.col("top") + F.col("image_width")
    inside = ~F.col("crop") | ((F.col("left") >= 0) & (F.col("top") >= 0) & (right <= F.col("raw_width")) & (bottom <= F.col("raw_height")))
    px, py = F.rint("cx").cast("int"), F.rint("cy").cast("int")
    lon, lat = pixel_to_gps(px, py, F.col("raw_width"), F.col("raw_height"))
    of = lambda new, old: F.when(F.col("crop"), new).otherwise(old)
    return rows.select(
        F.concat("token", "suffix").alias("token"), F.col("token").alias("parent"), "split", "kind", "dx", "dy", "crop_angle", "rotation", "source_image", "source_split", "city", "image_width",
        of(F.col("left"), F.coalesce("x_min", F.lit(0))).alias("x_min"), of(F.col("top"), F.coalesce("y_min", F.lit(0))).alias("y_min"),
        of(right, F.coalesce("x_max", "image_width")).alias("x_max"), of(bottom, F.coalesce("y_max", "image_width")).alias("y_max"),
        of(px, F.coalesce("center_x", F.lit(0)).cast("int")).alias("center_x"), of(py, F.coalesce("center_y", F.lit(0)).cast("int")).alias("center_y"),
        of(lon, F.col("lon")).alias("lon"), of(lat, F.col("lat")).alias("lat"), inside.alias("inside"), "crop", "cx", "cy", "size", "left", "top",
    )


_HELPERS = ("crop", "cx", "cy", "size", "left", "top")


def places(base: DataFrame, satellites: DataFrame, tiles: DataFrame, bounds: DataFrame, augmentation: Augmentation, order: list, ratio: float = 0.2, augment_val: bool = False) -> DataFrame:
    """The rows of ``samples`` without their lines, which splits, geometry and summary need not. ``tiles``: ``source_image, raw_width, raw_height`` of the raw images."""
    return _places(base, satellites, tiles, bounds, augmentation, order, ratio, augment_val).drop(*_HELPERS)


def counted(base: DataFrame, own: DataFrame, satellites: DataFrame, tiles: DataFrame, raw: DataFrame, bounds: DataFrame, augmentation: Augmentation, order: list, ratio: float = 0.2, augment_val: bool = False) -> DataFrame:
    """The rows of ``places`` with ``num_lines``, how many lines ``samples`` gives them, and no line in a row.

    ``own`` are the lines of patches (``token, points``), ``raw`` those of raw images (``source_image, points``), a row each. Crops of one
    place, angle and size have the same lines, so those are counted once for a distinct crop, however many samples have it.
    """
    rows = settled(_places(base, satellites, tiles, bounds, augmentation, order, ratio, augment_val), "places")
    key = ["source_image", "cx", "cy", "angle", "left", "top", "size"]
    rows = rows.withColumn("angle", F.coalesce("crop_angle", F.lit(0.0)))
    two = F.size("points") >= 2
    mine = own.groupBy(F.col("token").alias("parent")).agg(F.count("*").alias("all"), F.count_if(two).alias("turned"))
    crops = rows.filter("crop AND inside").select(*key).distinct()
    crops = crops.withColumns({"c": F.cos(F.radians("angle")), "s": F.sin(F.radians("angle"))})
    col = F.col

    def near(p: Column) -> Column:
        x = col("cx") + (p["x"] - col("cx")) * col("c") - (p["y"] - col("cy")) * col("s") - col("left")
        y = col("cy") + (p["x"] - col("cx")) * col("s") + (p["y"] - col("cy")) * col("c") - col("top")
        return (x >= -MARGIN) & (x <= col("size") + MARGIN) & (y >= -MARGIN) & (y <= col("size") + MARGIN)

    cut = raw.filter(two).select("source_image", "points").join(crops, "source_image").filter(F.size(F.filter("points", near)) >= 2)
    cut = settled(cut.groupBy(*key).agg(F.count("*").alias("cut")), "crop-lines")
    rows = rows.join(mine, "parent", "left").join(cut, key, "left")
    n = F.when(~col("inside"), 0).when(col("crop"), col("cut")).when(col("rotation").isNull(), col("all")).otherwise(col("turned"))
    return rows.withColumn("num_lines", F.coalesce(n, F.lit(0)).cast("int")).drop(*_HELPERS, "angle", "all", "turned", "cut")


def samples(base: DataFrame, satellites: DataFrame, raw: DataFrame, bounds: DataFrame, augmentation: Augmentation, order: list, ratio: float = 0.2, augment_val: bool = False) -> DataFrame:
    """A row for every sample: ``token, parent, split, kind``, its shift and angles, source, crop, place, ``lines``, and whether its crop is ``inside``.

    Only patches with a satellite image (``token``) take part. Augmentations are the product with a small literal table; crops need
    the raw image of the patch. Crops beyond the raw image stay as rows without lines, to be counted.
    """
    rows = _places(base, satellites, raw.filter("raw_lines IS NOT NULL"), bounds, augmentation, order, ratio, augment_val)
    rows = rows.join(base.select(F.col("token").alias("parent"), F.col("lines").alias("own")), "parent").join(raw.select("source_image", "raw_lines"), "source_image", "left")
    cropped = _cropped(F.col("raw_lines"), F.col("cx"), F.col("cy"), F.coalesce("crop_angle", F.lit(0.0)), F.col("left"), F.col("top"), F.col("size"))
    kept = F.when(~F.col("inside"), F.array().cast(LINES)).when(F.col("crop"), cropped).otherwise(F.col("own"))
    rows = rows.withColumn("cut", kept)
    lines = F.when(F.col("rotation").isNull(), F.col("cut")).otherwise(_turned(F.col("cut"), F.col("rotation"), F.col("size")))
    return rows.withColumn("lines", F.coalesce(lines, F.array().cast(LINES))).drop(*_HELPERS, "own", "raw_lines", "cut")


def splits(rows: DataFrame, order: list) -> DataFrame:
    """``split, pos, token`` of samples; ``order`` sorts tokens within a split."""
    out = numbered(rows.filter("inside").select("token", "split"), ["split", *order], "place")
    first = out.groupBy("split").agg(F.min("place").alias("first"))
    return out.join(F.broadcast(first), "split").select("split", (F.col("place") - F.col("first")).alias("pos"), "token")


def patch_geometry(rows: DataFrame) -> DataFrame:
    """The places of samples that have one."""
    crop = F.struct("x_min", "y_min", "x_max", "y_max", "center_x", "center_y", F.col("source_image").alias("original_image"), "source_split", "city")
    placed = rows.filter("inside AND lon IS NOT NULL AND lat IS NOT NULL")
    return placed.select("token", "lon", "lat", "image_width", F.col("image_width").alias("image_height"), crop.alias("crop_region"), "kind", "parent", "dx", "dy", "crop_angle", "rotation")


def _image() -> Column:
    return F.concat("token", F.lit("_satellite.png")).alias("image_name")


def manifest(rows: DataFrame) -> DataFrame:
    """A row for each sample; ``rows`` have ``num_lines`` or ``lines``."""
    n = F.col("num_lines") if "num_lines" in rows.columns else F.size("lines").alias("num_lines")
    return rows.filter("inside").select("token", "split", _image(), "kind", "parent", "dx", "dy", "crop_angle", "rotation", "source_image", "source_split", "city", n)


def summary(rows: DataFrame) -> DataFrame:
    """A row for each counter: samples by split and kind, skipped crops by kind, and totals."""
    counters = rows.filter("inside").groupBy(F.concat_ws("_", "split", "kind").alias("counter")).agg(F.count("*").alias("n"))
    skipped = rows.filter(~F.col("inside") & F.col("rotation").isNull()).groupBy(F.concat(F.lit("skip_"), "kind", F.lit("_out_of_bounds")).alias("counter")).agg(F.count("*").alias("n"))
    totals = rows.agg(F.count_if(F.col("kind") == "base").alias("num_base_tokens"), F.count_if("inside").alias("num_annotations"), F.count_if(F.col("inside") & F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("num_patch_geometry"))
    names = ("num_base_tokens", "num_annotations", "num_patch_geometry")
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in names])))
    return counters.unionByName(skipped).unionByName(totals)


def build(rows: DataFrame, order: list) -> dict[str, DataFrame]:
    """``annotations, splits, patch_geometry, manifest, summary`` of ``samples``, which is written once and read for each."""
    rows = settled(rows, "samples")
    annotations = rows.filter("inside").select(_image(), "token", "image_width", "source_image", "source_split", "city", F.posexplode("lines").alias("line_idx", "l"))
    annotations = annotations.select("image_name", "token", "image_width", "source_image", "source_split", "city", "line_idx", "l.category", "l.line_type", "l.points")
    return {"annotations": annotations, "splits": splits(rows, order), "patch_geometry": patch_geometry(rows), "manifest": manifest(rows), "summary": summary(rows)}


def summary_of(counters: Iterable) -> dict[str, int]:
    """Rows of the summary as a dictionary."""
    return {r.counter: r.n for r in counters}
