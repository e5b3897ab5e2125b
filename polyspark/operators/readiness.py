"""Whether a dataset is complete: counters for each split, with examples of what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 5
#: Parts of a split whose first examples are found apart.
PARTS = 64
_PROBLEMS = ("missing_image", "missing_annotation", "empty_annotation")


class NotReady(ValueError):
    """A dataset that lacks something."""


def first_of_each(rows: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of every group: of parts first, then of what those leave, so a hot group is never one window."""
    part = F.pmod(F.xxhash64(order), F.lit(PARTS))
    few = rows.withColumn("__part", part).withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(order)))
    few = few.filter(F.col("__n") <= most).withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    return few.filter(F.col("__n") <= most).drop("__part", "__n")


def readiness(expected: DataFrame, images: DataFrame, annotations: DataFrame, max_scan: int | None = None) -> DataFrame:
    """A row for each split: ``total, scanned, image_exists, annotation_exists, annotation_nonempty`` and the first five tokens of each problem.

    ``expected`` has ``split, pos, token``, ``images`` has ``token``, ``annotations`` ``token, num_lines``. Only the first ``max_scan``
    of a split are scanned; all are counted.
    """
    lines = annotations.groupBy("token").agg(F.max("num_lines").alias("num_lines"), F.lit(True).alias("has"))
    rows = expected.withColumn("scanned", F.lit(True) if max_scan is None else F.col("pos") < max_scan)
    rows = rows.join(images.select("token").distinct().withColumn("image", F.lit(True)), "token", "left").join(lines, "token", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    filled = F.coalesce(F.col("num_lines") > 0, F.lit(False))
    counts = rows.groupBy("split").agg(
        F.count("*").alias("total"), F.count_if("scanned").alias("scanned"), F.count_if(F.col("scanned") & yes("image")).alias("image_exists"),
        F.count_if(F.col("scanned") & yes("has")).alias("annotation_exists"), F.count_if(F.col("scanned") & filled).alias("annotation_nonempty"),
    )
    bad = F.array(F.when(~yes("image"), _PROBLEMS[0]), F.when(~yes("has"), _PROBLEMS[1]), F.when(yes("has") & ~filled, _PROBLEMS[2]))
    bad = rows.filter("scanned").select("split", "token", F.explode(F.filter(bad, lambda b: b.isNotNull())).alias("problem"))
    shown = first_of_each(bad, ["split", "problem"], "token", EXAMPLES)
    shown = shown.groupBy("split").pivot("problem", list(_PROBLEMS)).agg(F.array_sort(F.collect_list("token")))
    empty = F.array().cast("array<string>")
    out = counts.join(shown, "split", "left")
    return out.select(*counts.columns, *[F.coalesce(p, empty).alias(p) for p in _PROBLEMS])


def report(rows: DataFrame) -> tuple[str, int]:
    """A text of the counters, a line for each split (their number is small), and an exit code: 0 where nothing scanned is missing or empty."""
    out, code = [], 0
    for r in rows.orderBy("split").collect():
        out.append(f"{r.split}: {r.total} in all, {r.scanned} scanned, {r.image_exists} images, {r.annotation_exists} annotations, {r.annotation_nonempty} with lines")
        for p in _PROBLEMS:
            if r[p]:
                out.append(f"  {p}: {', '.join(r[p])}")
                code = 1
    return "\n".join(out), code


def check(rows: DataFrame) -> None:
    """Raises ``NotReady`` with the report where something is missing."""
    text, code = report(rows)
    if code:
        raise NotReady(text)
