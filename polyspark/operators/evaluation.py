"""The official evaluation of predicted lines: scores, matching at all thresholds, average precision and its means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.operators import metrics
from polyspark.operators.raster import as_arrays
from polyspark.operators.stages import settled

# The thresholds of the official scores.
MASK_THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
CHAMFER_THRESHOLDS = (0.9, 1.5, 3.0, 4.5)
LINE_WIDTH = 6
METRES_PER_PIXEL = 0.15
STEP = 0.25
#: Most distances that are held at once for a pair of lines.
BLOCK = 1 << 20


def score_mode(pred: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``score_mode``: whether lines of these categories came with scores, without, or both. ``fallback`` marks a line without."""
    lines = pred.filter(F.col("category").isin(*categories))
    both = lines.agg(F.bool_or("fallback").alias("f"), F.bool_or(~F.col("fallback")).alias("e"))
    mode = F.when(F.col("f") & F.col("e"), "mixed_explicit_and_constant_fallback").when(F.col("e"), "explicit_line_scores").otherwise("constant_1.0_fallback")
    return both.select(mode.alias("score_mode"))


def chamfer_of(a: np.ndarray, b: np.ndarray) -> float:
    """Mean of both one-way mean distances of two point sets, in blocks."""
    if not len(a) or not len(b):
        return g.FAR
    rows = max(1, BLOCK // len(b))
    to_b, to_a = [], np.full(len(b), np.inf)
    for k in range(0, len(a), rows):
        part = a[k : k + rows]
        d = np.sqrt((part[:, None, 0] - b[None, :, 0]) ** 2 + (part[:, None, 1] - b[None, :, 1]) ** 2)
        to_b.append(d.min(axis=1))
        np.minimum(to_a, d.min(axis=0), out=to_a)
    return float((np.concatenate(to_b).mean() + to_a.mean()) / 2)


def _chamfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cost = [chamfer_of(p, q) for p, q in zip(as_arrays(b.column("p")), as_arrays(b.column("q")))]
        kept = [b.column(c) for c in ("sample", "category", "pred_idx", "gt_idx")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(cost, pa.float64())], ["sample", "category", "pred_idx", "gt_idx", "cost"])


def chamfer_costs(pred: DataFrame, gt: DataFrame, metres: float = METRES_PER_PIXEL, step: float = STEP) -> DataFrame:
    """``sample, category, pred_idx, gt_idx, cost``: Chamfer distance in metres of lines cut every ``step``.

    Lines are densified once each, before the pairs of a sample and category are joined; distances are taken in blocks.
    """
    k = F.lit(float(metres))

    def dense(df: DataFrame, idx: str, name: str) -> DataFrame:
        # a generator of one row: cutting looks at every vertex twice, which would scale all of them each time
        rows = df.select("sample", "category", idx, F.inline(F.array(F.struct(g.scale(F.col("points"), k, k).alias("scaled")))))
        return rows.select("sample", "category", idx, g.densify(F.col("scaled"), step).alias(name))

    pairs = dense(pred, "pred_idx", "p").join(dense(gt, "gt_idx", "q"), ["sample", "category"])
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    out = ", ".join(f"{c} {kind[c]}" for c in ("sample", "category", "pred_idx", "gt_idx"))
    return pairs.mapInArrow(_chamfers, f"{out}, cost double")


def mask_costs(pred: DataFrame, gt: DataFrame, width: float = LINE_WIDTH, size: int = 512) -> DataFrame:
    """As ``chamfer_costs`` with the negative mask IoU; pairs without a common pixel are not there and match at no threshold above 0."""
    return metrics.mask_iou(pred, gt, width, size).withColumn("cost", -F.col("iou")).drop("iou")


def ranked(pred: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """``category, threshold, score, sample, pred_idx, tp`` of every prediction at every threshold."""
    hits = found.groupBy("sample", "category", "pred_idx").agg(F.collect_set("threshold").alias("at"))
    rows = pred.select("sample", "category", "pred_idx", "score").join(hits, ["sample", "category", "pred_idx"], "left")
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    tp = F.coalesce(F.array_contains("at", F.col("threshold")), F.lit(False))
    return rows.select("category", "threshold", "score", "sample", "pred_idx", tp.alias("tp"))


def official_ap(pred: DataFrame, gt: DataFrame, costs: DataFrame, thresholds: list[float]) -> DataFrame:
    """``category, threshold, ap`` of every category that has truth. ``pred`` has ``score``; predictions go by score, sample and number.

    ``costs`` is ``chamfer_costs``, or ``mask_costs`` with negative thresholds.
    """
    best_first = pred.select("sample", "category", "pred_idx", (-F.col("score")).alias("ord"))
    found = metrics.matches(costs.join(best_first, ["sample", "category", "pred_idx"]), thresholds)
    truths = gt.groupBy("category").agg(F.count("*").alias("num_gt"))
    levels = gt.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    truths = truths.crossJoin(F.broadcast(levels))
    return metrics.average_precision(ranked(pred, found, thresholds), truths, ["category", "threshold"], [F.desc("score"), "sample", "pred_idx"])


def mean_ap(aps: DataFrame) -> DataFrame:
    """``threshold, ap``: the mean over categories that have truth; a last row without threshold is the mean over thresholds."""
    per = aps.groupBy("threshold").agg(F.avg("ap").alias("ap"))
    return per.unionByName(per.agg(F.avg("ap").alias("ap")).select(F.lit(None).cast("double").alias("threshold"), "ap"))


def evaluate(
    pred: DataFrame, gt: DataFrame, categories: tuple[str, ...], size: int = 512, width: float = LINE_WIDTH, metres: float = METRES_PER_PIXEL,
    mask_thresholds: tuple[float, ...] = MASK_THRESHOLDS, chamfer_thresholds: tuple[float, ...] = CHAMFER_THRESHOLDS,
) -> DataFrame:
    """``metric, category, value``: ``mIoU``, ``APM``, ``APM50`` and so on, ``APC0.9`` and so on; rows without a category are means.

    ``pred`` and ``gt`` as ``read_predictions`` gives them, in pixels.
    """
    pred, gt = (x.filter(F.col("category").isin(*categories)) for x in (pred, gt))
    masks = [-t for t in mask_thresholds]
    by_mask = official_ap(pred, gt, mask_costs(pred, gt, width, size), masks).withColumn("threshold", -F.col("threshold"))
    by_chamfer = official_ap(pred, gt, chamfer_costs(pred, gt, metres), list(chamfer_thresholds))
    name = {"APM": F.format_string("APM%d", F.round(F.col("threshold") * 100).cast("int")), "APC": F.format_string("APC%.1f", "threshold")}
    none = F.lit(None).cast("string").alias("category")
    out = metrics.semantic_miou(pred, gt, width, size).select(F.lit("mIoU").alias("metric"), "category", F.col("iou").alias("value"))
    out = out.unionByName(out.groupBy("metric").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value")).select("metric", none, "value"))
    for kind, aps in (("APM", by_mask), ("APC", by_chamfer)):
        aps = settled(aps, "average-precision")
        out = out.unionByName(aps.select(name[kind].alias("metric"), "category", F.col("ap").alias("value")))
        means = mean_ap(aps)
        if kind == "APC":
            means = means.filter("threshold IS NOT NULL")
        out = out.unionByName(means.select(F.when(F.col("threshold").isNull(), kind).otherwise(name[kind]).alias("metric"), none, F.col("ap").alias("value")))
    return out
