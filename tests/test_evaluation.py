"""Official scores against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspark.operators import evaluation as ev
from polyspark.operators import metrics
from polyspark.operators.stages import numbered

POINTS = "array<struct<x:double,y:double>>"


def brute_ap(hits, n_truth):
    """Area under the envelope of precision over recall."""
    c, curve = 0, []
    for k, hit in enumerate(hits, 1):
        c += hit
        curve.append((c / n_truth, c / k))
    area, last = 0.0, 0.0
    for i, (recall, _) in enumerate(curve):
        area += (recall - last) * max(p for _, p in curve[i:])
        last = recall
    return area


def test_category_of_any_size(spark):
    """One category with most rows, in many partitions, equal scores among them; others small or without a hit."""
    rng = np.random.default_rng(0)
    rows = [("big", round(float(s), 3), i, bool(h)) for i, (s, h) in enumerate(zip(rng.random(6000), rng.random(6000) < 0.3))]
    rows += [("even", 1.0, i, i % 3 == 0) for i in range(500)] + [("none", 0.5, i, False) for i in range(9)] + [("one", 0.5, 0, True)]
    df = spark.createDataFrame(rows, "category string, score double, idx int, tp boolean").repartition(7)
    truths = spark.createDataFrame([("big", 2500), ("even", 200), ("none", 4), ("one", 2), ("empty", 3), ("zero", 0)], "category string, num_gt int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.category: r.ap for r in metrics.average_precision(df, truths, ["category"], [F.desc("score"), "idx"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {"none": 0.0, "empty": 0.0}
    for c, n in (("big", 2500), ("even", 200), ("one", 2)):
        want[c] = brute_ap([r[3] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))], n)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_numbers_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(1).alias("n")).repartition(9)
    rows = numbered(df, ["v"], "at").collect()
    assert all(r.at == r.v for r in rows) and len(rows) == 5000 and rows[0].n == 1


def random_sides(seed):
    rng = np.random.default_rng(seed)
    line = lambda: [tuple(map(float, p)) for p in np.cumsum(rng.integers(-12, 13, (rng.integers(1, 5), 2)), axis=0) + rng.integers(10, 54, 2)]
    pred, gt = [], []
    for s in range(6):
        truth = [(s, int(k), ["a", "b"][k % 2], line()) for k in range(rng.integers(1, 7))]
        gt += truth
        for k in range(rng.integers(1, 9)):
            base = truth[rng.integers(len(truth))]
            near = [(x + float(rng.integers(-2, 3)), y + float(rng.integers(-2, 3))) for x, y in base[3]] if rng.random() < 0.7 else line()
            score = float(rng.choice([0.1, 0.5, 0.5, 0.9])) if rng.random() < 0.8 else None
            pred.append((s, k, base[2], near, 1.0 if score is None else score, score is None))
    return pred, gt


def mask(points, size, width):
    y, x = np.mgrid[:size, :size].astype(float)
    out = np.zeros((size, size), bool)
    for (px, py), (qx, qy) in zip(points, points[1:]):
        d = (qx - px) ** 2 + (qy - py) ** 2
        t = np.clip(((x - px) * (qx - px) + (y - py) * (qy - py)) / d, 0, 1) if d else np.zeros_like(x)
        out |= (px + t * (qx - px) - x) ** 2 + (py + t * (qy - py) - y) ** 2 <= (width / 2) ** 2
    return out


def dense(points, step):
    out = [np.array(points[0])]
    for p, q in zip(points, points[1:]):
        p, q = np.array(p), np.array(q)
        n = max(1, int(np.ceil(np.hypot(*(q - p)) / step)))
        out += [p + (q - p) * k / n for k in range(1, n + 1)]
    return np.array(out)


def brute_scores(pred, gt, cost, thresholds, better):
    out = {}
    for c in ("a", "b"):
        n = sum(g[2] == c for g in gt)
        for t in thresholds:
            used, hits = set(), []
            for p in sorted((p for p in pred if p[2] == c), key=lambda p: (-p[4], p[0], p[1])):
                free = [(cost(p[3], g[3]), g[1]) for g in gt if g[0] == p[0] and g[2] == c and (g[0], g[1]) not in used]
                best = min(free, key=lambda f: (f[0] if better == "low" else -f[0], f[1]), default=None)
                ok = best is not None and (best[0] <= t if better == "low" else best[0] >= t)
                if ok:
                    used.add((p[0], best[1]))
                hits.append(ok)
            if n:
                out[c, t] = brute_ap(hits, n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_evaluate(spark, seed):
    pred, gt = random_sides(seed)
    p = spark.createDataFrame(pred, f"sample int, pred_idx int, category string, points {POINTS}, score double, fallback boolean")
    t = spark.createDataFrame(gt, f"sample int, gt_idx int, category string, points {POINTS}")
    masks, chamfers = (0.3, 0.5, 0.75), (0.3, 0.9)
    got = {(r.metric, r.category): r.value for r in ev.evaluate(p, t, ("a", "b"), 64, 6.0, 0.15, masks, chamfers).collect()}

    def iou(a, b):
        a, b = mask(a, 64, 6), mask(b, 64, 6)
        return (a & b).sum() / (a | b).sum() if (a | b).any() else 0.0

    def chamfer(a, b):
        a, b = dense(np.array(a) * 0.15, 0.25), dense(np.array(b) * 0.15, 0.25)
        d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
        return (d.min(1).mean() + d.min(0).mean()) / 2

    by_mask, by_chamfer = brute_scores(pred, gt, iou, masks, "high"), brute_scores(pred, gt, chamfer, chamfers, "low")
    want = {(f"APM{round(x * 100)}", c): v for (c, x), v in by_mask.items()} | {(f"APC{x:.1f}", c): v for (c, x), v in by_chamfer.items()}
    mean = lambda d, x: np.mean([v for (_, y), v in d.items() if y == x])
    want |= {(f"APM{round(x * 100)}", None): mean(by_mask, x) for x in masks} | {(f"APC{x:.1f}", None): mean(by_chamfer, x) for x in chamfers}
    want["APM", None] = np.mean([mean(by_mask, x) for x in masks])
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    ious = {}
    for c in ("a", "b"):
        i = u = 0
        for s in range(6):
            a, b = (np.any([mask(x[3], 64, 6) for x in rows if x[0] == s and x[2] == c] or [np.zeros((64, 64), bool)], axis=0) for rows in (pred, gt))
            i, u = i + (a & b).sum(), u + (a | b).sum()
        ious[c] = i / u
    assert abs(got["mIoU", None] - np.mean([*ious.values()])) < 1e-9
    assert {k for k in got} == set(want) | {("mIoU", None), ("mIoU", "a"), ("mIoU", "b")}


def test_score_modes(spark):
    for flags, want in (([True, False], "mixed_explicit_and_constant_fallback"), ([False], "explicit_line_scores"), ([True], "constant_1.0_fallback"), ([], "constant_1.0_fallback")):
        rows = spark.createDataFrame([("a", f) for f in flags] + [("other", True)], "category string, fallback boolean")
        assert ev.score_mode(rows, ("a",)).first().score_mode == want
