"""Scoring predicted lines against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.functions import text
from polyspark.operators.raster import segment_words
from polyspark.operators.stages import settled

#: Distance that stands for a category without truth, and for no predictions.
NO_TRUTH = 64.0


def pair_costs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Chamfer distance of each prediction and truth of a sample and category: an equi-join, bounded by the lines of a patch."""
    a = pred.select("sample", "category", "pred_idx", F.col("points").alias("p"))
    b = gt.select("sample", "category", "gt_idx", F.col("points").alias("q"))
    return a.join(b, ["sample", "category"]).select("sample", "category", "pred_idx", "gt_idx", g.chamfer(F.col("p"), F.col("q")).alias("cost"))


def mean_chamfer(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``sample, mean_chamfer``: each prediction's nearest truth of its category."""
    near = pair_costs(pred, gt).groupBy("sample", "pred_idx").agg(F.min("cost").alias("near"))
    rows = pred.select("sample", "pred_idx").join(near, ["sample", "pred_idx"], "left")
    return rows.groupBy("sample").agg(F.avg(F.coalesce("near", F.lit(NO_TRUTH))).alias("mean_chamfer"))


def matches(costs: DataFrame, thresholds: list[float], order: str = "ord") -> DataFrame:
    """``threshold, sample, category, pred_idx, gt_idx``: at each threshold, predictions in the order of ``order`` and ``pred_idx`` take
    the nearest free truth that is near enough (of equal ones the first).

    A pair beyond a threshold never matches there, whatever is free, so only pairs within the largest one are gathered. One fold for
    each threshold runs over the same lists; a patch bounds the lines of a sample and category.
    """
    near = costs.filter(F.col("cost") <= max(thresholds)).groupBy("sample", "category", order, "pred_idx")
    near = near.agg(F.array_sort(F.collect_list(F.struct("cost", "gt_idx"))).alias("near"))
    per = near.groupBy("sample", "category").agg(F.array_sort(F.collect_list(F.struct(order, "pred_idx", "near"))).alias("preds"))
    empty = F.array().cast("array<struct<pred_idx:bigint,gt_idx:bigint>>")
    pair = lambda p, n: F.struct(p["pred_idx"].cast("long").alias("pred_idx"), n["gt_idx"].cast("long").alias("gt_idx"))

    def fold(t):
        def step(done, p):
            free = F.filter(p["near"], lambda n: (n["cost"] <= t) & ~F.exists(done, lambda d: d["gt_idx"] == n["gt_idx"]))
            return g.let(F.get(free, F.lit(0)), lambda n: F.when(n.isNull(), done).otherwise(F.array_append(done, pair(p, n))))

        return F.aggregate("preds", empty, step)

    levels = F.transform(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.struct(t.alias("threshold"), fold(t).alias("m")))
    rows = per.select("sample", "category", F.inline(levels))
    return rows.select("threshold", "sample", "category", F.inline("m"))


def greedy_match(costs: DataFrame, order: str, threshold: float) -> DataFrame:
    """``sample, category, pred_idx, gt_idx``: ``matches`` at one threshold."""
    return matches(costs, [threshold], order).drop("threshold")


def f1_at(pred: DataFrame, gt: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, tp, fp, fn, f1`` over all samples, predictions in their own order: one table of costs for all thresholds."""
    found = matches(pair_costs(pred, gt).withColumn("ord", F.col("pred_idx")), thresholds).groupBy("threshold").agg(F.count("*").alias("tp"))
    sizes = pred.agg(F.count("*").alias("n_pred")).crossJoin(gt.agg(F.count("*").alias("n_gt")))
    rows = sizes.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).join(F.broadcast(found), "threshold", "left")
    rows = rows.withColumn("tp", F.coalesce("tp", F.lit(0).cast("long")))
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_gt", F.lit(1))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return rows.select("threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), f1.alias("f1"))


def average_precision(rows: DataFrame, truths: DataFrame, group: list[str], order: list) -> DataFrame:
    """``group, ap``: area under the monotone precision envelope of rows ``tp`` (boolean) in ``order``. ``truths`` has ``num_gt``.

    Rows are sorted by range of group and order, so a group of any size lies in many partitions. Counts by partition give
    every partition its offsets; the envelope comes back the same way, from the best precision of later partitions. Only windows
    over one partition's rows and over one row for each partition are taken.
    """
    place = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select(*group, "tp", place.alias("place"))
    rows = settled(rows, "ranked").withColumn("part", F.shiftright("place", 33))
    parts = [*group, "part"]
    upto = Window.partitionBy(*parts).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*parts).agg(F.count("*").alias("n"), F.count_if("tp").alias("c"))
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0")
    hits = rows.join(totals.select(*parts, start("n"), start("c")), parts)
    count = F.col("c0") + F.sum(F.col("tp").cast("long")).over(upto)
    hits = hits.withColumn("precision", count / (F.col("n0") + F.row_number().over(upto))).filter("tp").select(*parts, "place", "precision")
    later = Window.partitionBy(*group).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    best = hits.groupBy(*parts).agg(F.max("precision").alias("best"))
    best = best.select(*parts, F.max("best").over(later).alias("beyond"))
    back = Window.partitionBy(*parts).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    # recall grows by one truth at each hit
    envelope = F.greatest(F.max("precision").over(back), "beyond")
    area = hits.join(best, parts).withColumn("envelope", envelope).groupBy(*group).agg(F.sum("envelope").alias("area"))
    return truths.filter("num_gt > 0").join(area, group, "left").select(*group, F.coalesce(F.col("area") / F.col("num_gt"), F.lit(0.0)).alias("ap"))


def mask_metrics(pixels: DataFrame, image: str, threshold: float) -> DataFrame:
    """``image, iou, f1, positive, mean_prob`` of pixel rows ``prob, target`` (boolean)."""
    hit = F.col("prob") >= threshold
    rows = pixels.groupBy(image).agg(
        F.count_if(hit & F.col("target")).alias("i"), F.count_if(hit | F.col("target")).alias("u"), F.count_if(hit).alias("positive"), F.count_if("target").alias("t"), F.avg("prob").alias("mean_prob")
    )
    eps = 1e-6
    return rows.select(image, ((F.col("i") + eps) / (F.col("u") + eps)).alias("iou"), ((2 * F.col("i") + eps) / (F.col("positive") + F.col("t") + eps)).alias("f1"), "positive", "mean_prob")


def rasterize(lines: DataFrame, keys: list[str], width: float | Column, size: int) -> DataFrame:
    """``keys, word, bits``: the pixels of all lines with the same ``keys``, one row for each word with a pixel."""
    return segment_words(lines, keys, width, size).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def mask_iou(pred: DataFrame, gt: DataFrame, width: float, size: int) -> DataFrame:
    """``sample, category, pred_idx, gt_idx, iou`` of the pairs that share a pixel."""
    a = rasterize(pred, ["sample", "category", "pred_idx"], width, size)
    b = rasterize(gt, ["sample", "category", "gt_idx"], width, size)
    area = lambda df, idx, name: df.groupBy("sample", "category", idx).agg(F.sum(F.bit_count("bits")).alias(name))
    na, nb = area(a, "pred_idx", "na"), area(b, "gt_idx", "nb")
    common = a.join(b.withColumnRenamed("bits", "other"), ["sample", "category", "word"]).withColumn("n", F.bit_count(F.col("bits").bitwiseAND(F.col("other"))))
    common = common.groupBy("sample", "category", "pred_idx", "gt_idx").agg(F.sum("n").alias("n")).filter("n > 0")
    both = common.join(na, ["sample", "category", "pred_idx"]).join(nb, ["sample", "category", "gt_idx"])
    return both.select("sample", "category", "pred_idx", "gt_idx", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("iou"))


def semantic_miou(pred: DataFrame, gt: DataFrame, width: float, size: int) -> DataFrame:
    """``category, iou``: pixels of all samples together; only categories that have a pixel. One aggregation of both sides' words."""
    none = F.lit(0).cast("long")
    words = lambda df: segment_words(df, ["sample", "category"], width, size)
    both = words(pred).select("sample", "category", "word", F.col("bits").alias("p"), none.alias("g"))
    both = both.unionByName(words(gt).select("sample", "category", "word", none.alias("p"), F.col("bits").alias("g")))
    both = both.groupBy("sample", "category", "word").agg(F.bit_or("p").alias("p"), F.bit_or("g").alias("g"))
    common, either = F.sum(F.bit_count(F.col("p").bitwiseAND(F.col("g")))), F.sum(F.bit_count(F.col("p").bitwiseOR(F.col("g"))))
    return both.groupBy("category").agg((common / either).alias("iou"))


def continuity(lines: DataFrame, radius: float) -> DataFrame:
    """``sample, score``: the share of line ends with an end of another line of the sample within ``radius``.

    Ends meet by grid cells of the radius' size: each end looks into nine cells, never at all others.
    """
    ends = lines.select("sample", "line", F.posexplode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1))).alias("side", "e"))
    cell = lambda c: F.floor(F.col("e")[c] / radius).cast("long")
    ends = ends.withColumns({"cx": cell("x"), "cy": cell("y")})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probes = ends.withColumn("d", F.explode(near)).select("sample", F.col("line").alias("l"), F.col("side").alias("s"), F.col("e").alias("o"), (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    hit = probes.join(ends, ["sample", "cx", "cy"]).filter((F.col("l") != F.col("line")) & (g.distance(F.col("e"), F.col("o")) <= radius))
    hit = hit.select("sample", F.col("l").alias("line"), F.col("s").alias("side")).distinct().withColumn("hit", F.lit(1))
    return ends.join(hit, ["sample", "line", "side"], "left").groupBy("sample").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("score"))


def lane_masks(lines: DataFrame, size: int, width: float, positive: tuple[str, ...]) -> DataFrame:
    """``image, word, bits``: the mask of each image's lines of the ``positive`` categories (``image, category, points, image_width, image_height``).

    Points are scaled from source pixels to ``size``, and the stroke with them, to whole pixels and one at least. Missing sizes are ``size``.
    """
    source = lambda c: F.coalesce(F.col(c), F.lit(size))
    ratio = lambda c: F.lit(float(max(1, size - 1))) / F.greatest(F.lit(1), source(c) - 1)
    rows = lines.filter(text.category(F.col("category")).isin(*positive) & (F.size("points") >= 2))
    stroke = F.greatest(F.lit(1.0), F.rint(F.lit(width * size) / F.greatest(F.lit(1), source("image_width"))))
    points = g.scale(F.col("points"), ratio("image_width"), ratio("image_height"))
    return rasterize(rows.select("image", points.alias("points"), stroke.alias("stroke")), ["image"], F.col("stroke"), size)


def mask_scores(pred: DataFrame, gt: DataFrame, image: str = "image") -> DataFrame:
    """``image, iou, f1, positive`` of masks as words, for every image with a pixel on either side."""
    none, eps = F.lit(0).cast("long"), 1e-6
    both = pred.select(image, "word", F.col("bits").alias("p"), none.alias("t")).unionByName(gt.select(image, "word", none.alias("p"), F.col("bits").alias("t")))
    both = both.groupBy(image, "word").agg(F.bit_or("p").alias("p"), F.bit_or("t").alias("t"))
    count = lambda c, name: F.sum(F.bit_count(c)).alias(name)
    p, t = F.col("p"), F.col("t")
    rows = both.groupBy(image).agg(count(p.bitwiseAND(t), "i"), count(p.bitwiseOR(t), "u"), count(p, "positive"), count(t, "true"))
    return rows.select(image, ((F.col("i") + eps) / (F.col("u") + eps)).alias("iou"), ((2 * F.col("i") + eps) / (F.col("positive") + F.col("true") + eps)).alias("f1"), "positive")
