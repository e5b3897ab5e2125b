"""The metric bundle of a prediction run, sample by sample, and runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyspark.operators import metrics

# Thresholds and radius in pixels, and the metrics of a comparison in their order.
THRESHOLDS = (2.0, 4.0, 8.0)
RADIUS = 12.0
SHOWN = ("APC@2px", "APC@4px", "APC@8px", "mean_chamfer_px", "continuity_pred", "continuity_gap", "pred_num_lines", "gt_num_lines")


def _long(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    one = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return rows.select("sample", F.inline(one))


def sample_metrics(samples: DataFrame, pred: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, radius: float = RADIUS) -> DataFrame:
    """``sample, metric, value`` of every sample: F1 at each threshold, mean Chamfer, continuity of both sides and its gap, numbers of lines.

    A sample counts with whatever it lacks: without predictions its F1 is 0 and its mean Chamfer that of no prediction. Costs are taken once for all thresholds.
    """
    costs = metrics.pair_costs(pred, gt).withColumn("ord", F.col("pred_idx"))
    hits = metrics.matches(costs, list(thresholds)).groupBy("sample", "threshold").agg(F.count("*").alias("tp"))
    count = lambda df, name: df.groupBy("sample").agg(F.count("*").alias(name))
    line = lambda df, idx: df.select("sample", F.col(idx).alias("line"), "points").filter(F.size("points") > 0)
    ends = lambda df, idx, name: metrics.continuity(line(df, idx), radius).withColumnRenamed("score", name)
    rows = samples.select("sample").distinct()
    for part in (count(pred, "np"), count(gt, "ng"), metrics.mean_chamfer(pred, gt), ends(pred, "pred_idx", "cp"), ends(gt, "gt_idx", "cg")):
        rows = rows.join(part, "sample", "left")
    rows = rows.fillna(0, ["np", "ng"]).fillna(0.0, ["cp", "cg"])
    level = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    tp = F.coalesce("tp", F.lit(0))
    p, r = tp / F.greatest("np", F.lit(1)), tp / F.greatest("ng", F.lit(1))
    f1 = rows.select("sample", "np", "ng", level).join(hits, ["sample", "threshold"], "left")
    f1 = f1.select("sample", F.format_string("APC@%dpx", F.col("threshold").cast("int")).alias("metric"), (2 * p * r / F.greatest(p + r, F.lit(1e-6))).alias("value"))
    return f1.unionByName(_long(rows, {
        "mean_chamfer_px": F.coalesce("mean_chamfer", F.lit(metrics.NO_TRUTH)), "continuity_pred": F.col("cp"), "continuity_gt": F.col("cg"),
        "continuity_gap": F.abs(F.col("cp") - F.col("cg")), "pred_num_lines": F.col("np"), "gt_num_lines": F.col("ng"),
    }))


def run_means(bundle: DataFrame) -> DataFrame:
    """``metric, value``: the mean over the samples that have the metric."""
    return bundle.groupBy("metric").agg(F.avg("value").alias("value"))


def compare_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """``metric`` and a column for each run (bundles ``sample, metric, value``): the union of all metrics, null where a run lacks one."""
    rows = None
    for name, bundle in runs.items():
        one = run_means(bundle).withColumn("run", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    value = lambda name: F.max(F.when(F.col("run") == name, F.col("value"))).alias(name)
    return rows.groupBy("metric").agg(*[value(name) for name in runs])


def comparison_markdown(compared: DataFrame, names: list[str], shown: tuple[str, ...] = SHOWN) -> str:
    """A table of the ``shown`` metrics, a column for each run; ``nan`` where a run lacks one."""
    found = {r.metric: r for r in compared.filter(F.col("metric").isin(*shown)).collect()}
    number = lambda m, n: f"{found[m][n]:.4f}" if m in found and found[m][n] is not None else "nan"
    rows = [f"| {m} | {' | '.join(number(m, n) for n in names)} |" for m in shown]
    return "\n".join([f"| Metric | {' | '.join(names)} |", "|---|" + "---:|" * len(names), *rows]) + "\n"
