"""Building and auditing train/validation snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions.geometry import EARTH_RADIUS
from polyspark.operators.stages import numbered

#: Place of what an external list lacks.
LAST = 10**9


def match_tokens(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, status``: whether each distinct token is on both sides, or on which one."""
    a, b = (x.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(s, F.lit(True)) for x, s in ((left, "l"), (right, "r")))
    status = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").select(key, status.alias("status"))


def token_key(token: str = "token") -> list:
    """Order columns of ``log__timestamp__frameN`` tokens: log, time, frame (-1 where absent), token."""
    parts = F.split(token, "__")
    number = lambda pattern: F.coalesce(F.element_at(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, pattern, 1)), lambda s: s != ""), -1).cast("long"), F.lit(-1))
    last = lambda pattern: F.when(F.size(F.filter(parts, lambda p: p.rlike(pattern))) > 0, number(pattern)).otherwise(F.lit(-1).cast("long"))
    return [F.get(parts, F.lit(0)).alias("log"), last("^([0-9]+)$").alias("stamp"), last("^frame([0-9]+)$").alias("frame"), F.col(token)]


def tail_split(rows: DataFrame, group: list[str], order: list, ratio: float) -> DataFrame:
    """Adds ``split``: of each group the last ``max(1, round(n * ratio))`` rows, n - 1 at most, are ``val``."""
    n = F.count("*").over(Window.partitionBy(*group))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    val = F.least(F.greatest(F.rint(n * ratio), F.lit(1)), n - 1)
    return rows.withColumn("split", F.when(at > n - val, "val").otherwise("train"))


def project_equirect(patches: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``x, y`` in metres about the mean position of all rows; one row is broadcast."""
    origin = patches.agg(F.avg(lon).alias("lon0"), F.avg(lat).alias("lat0"))
    rows = patches.crossJoin(F.broadcast(origin))
    x = F.radians(F.col(lon) - F.col("lon0")) * EARTH_RADIUS * F.cos(F.radians("lat0"))
    return rows.withColumns({"x": x, "y": F.radians(F.col(lat) - F.col("lat0")) * EARTH_RADIUS}).drop("lon0", "lat0")


def scan_order(patches: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``pos`` and ``prev`` (empty at first) in scan order: from the top, then from the left; patches without a place last."""
    by = Window.partitionBy(*group).orderBy(F.col("y").isNull(), F.desc("y"), "x", "token")
    return patches.withColumns({"pos": F.row_number().over(by), "prev": F.coalesce(F.lag("token").over(by), F.lit(""))})


def chain(frames: DataFrame, hops: int) -> DataFrame:
    """Adds ``h1`` to ``h{hops}``, the frames found by following ``prev``: one equi-join for each hop."""
    out = frames
    for k in range(1, hops + 1):
        step = frames.select(F.col("token").alias("__t"), F.col("prev").alias(f"h{k}"))
        out = out.join(step, F.col("token" if k == 1 else f"h{k - 1}") == F.col("__t"), "left").drop("__t")
    return out


def augment(patches: DataFrame, spec: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Patches times ``spec`` (a small table ``name, dx, dy, angle``): those inside the tile, and counts by name.

    Patches have ``token, x_min, y_min, size``.
    """
    rows = patches.crossJoin(F.broadcast(spec))
    x, y = F.col("x_min") + F.col("dx"), F.col("y_min") + F.col("dy")
    inside = (x >= 0) & (y >= 0) & (x + F.col("size") <= width) & (y + F.col("size") <= height)
    rows = rows.select(F.concat_ws("__", "token", "name").alias("token"), F.col("token").alias("parent"), "name", x.alias("x_min"), y.alias("y_min"), "angle", inside.alias("inside"))
    counts = rows.groupBy("name").agg(F.count_if("inside").alias("kept"), F.count_if(~F.col("inside")).alias("skipped"))
    return rows.filter("inside").drop("inside"), counts


def axis_bounds(centres: DataFrame, group: list[str], value: str) -> DataFrame:
    """``low, high, step`` of an axis: its extreme cell centres and half the median step beyond."""
    cells = centres.select(*group, value).distinct()
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(value))
    out = cells.withColumn("step", step).groupBy(*group).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.coalesce(F.median("step"), F.lit(0.0)).alias("step"))
    return out.select(*group, (F.col("a") - F.col("step") / 2).alias("low"), (F.col("b") + F.col("step") / 2).alias("high"), "step")


def audit(docs: DataFrame, labels: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """Per group: how many rows there are, have text, have a label, and the first one without."""
    rows = docs.join(labels.select(key).distinct().withColumn("__l", F.lit(True)), key, "left")
    return rows.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(F.length(F.coalesce(text, F.lit(""))) > 0).alias("non_empty"),
        F.count_if(F.col("__l").isNotNull()).alias("labelled"),
        F.min(F.when(F.col("__l").isNull(), F.col(key))).alias("first_missing"),
    )


def in_order(rows: DataFrame, order: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order of an external list ``key, pos``: what the list lacks comes last, by ``key``; the first ``most`` stay.

    Of a key that is listed twice the first place counts. Places come from range partitions, not from one window.
    """
    first = order.groupBy(key).agg(F.min("pos").alias("__pos"))
    known = rows.join(first, key, "left").withColumn("__pos", F.coalesce(F.col("__pos").cast("long"), F.lit(LAST).cast("long")))
    out = numbered(known, ["__pos", key], "place").drop("__pos")
    return out if most is None else out.filter(F.col("place") < most)


def window_of(frames: DataFrame, length: int, empty: str = "") -> DataFrame:
    """``token, window``: the last ``length`` frames up to each one, oldest first, filled with ``empty`` in front where the chain is short.

    A frame that the table lacks ends the chain.
    """
    known = frames.select(F.col("token").alias("prev"), F.lit(True).alias("__known")).distinct()
    linked = frames.join(known, "prev", "left").select("token", F.when(F.col("__known"), F.col("prev")).alias("prev"))
    rows = chain(linked, length - 1)
    past = F.filter(F.array(*[F.col(f"h{k}") for k in range(length - 1, 0, -1)], F.col("token")), lambda t: t.isNotNull())
    return rows.select("token", F.concat(F.array_repeat(F.lit(empty).cast(frames.schema["token"].dataType), F.lit(length) - F.size(past)), past).alias("window"))
