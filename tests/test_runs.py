"""Comparison, cache and order in small."""

import json

import pytest

from polyspark.operators import cache, comparison, readiness, snapshot
from polyspark.sources import annotations as a


def test_runs_with_different_metrics(spark):
    row = "sample int, metric string, value double"
    a = spark.createDataFrame([(1, "APC@2px", 0.5), (2, "APC@2px", 1.0), (1, "extra", 2.0)], row)
    b = spark.createDataFrame([(1, "APC@2px", 0.25), (1, "gt_num_lines", 4.0)], row)
    out = comparison.compare_runs({"v1": a, "v2": b})
    assert {r.metric: (r.v1, r.v2) for r in out.collect()} == {"APC@2px": (0.75, 0.25), "extra": (2.0, None), "gt_num_lines": (None, 4.0)}
    text = comparison.comparison_markdown(out, ["v1", "v2"])
    assert "| APC@2px | 0.7500 | 0.2500 |" in text and "| gt_num_lines | nan | 4.0000 |" in text and text.startswith("| Metric | v1 | v2 |\n|---|---:|---:|\n")


def test_sample_without_anything(spark):
    side = lambda idx: spark.createDataFrame([], f"sample int, category string, {idx} int, points array<struct<x:double,y:double>>")
    got = {r.metric: r.value for r in comparison.sample_metrics(spark.createDataFrame([(1,)], "sample int"), side("pred_idx"), side("gt_idx")).collect()}
    assert got == {"APC@2px": 0.0, "APC@4px": 0.0, "APC@8px": 0.0, "mean_chamfer_px": 64.0, "continuity_pred": 0.0, "continuity_gt": 0.0, "continuity_gap": 0.0, "pred_num_lines": 0.0, "gt_num_lines": 0.0}


def test_only_missing_rows_are_computed(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("v", keys.k * 2)

    path, sign = f"{tmp_path}/cache", cache.signature({"b": [1, 2], "a": "x"})
    assert sign == cache.signature({"a": "x", "b": [1, 2]}) != cache.signature({"a": "x", "b": [2, 1]}) and len(sign) == 16
    keys = lambda *n: spark.createDataFrame([(k,) for k in n], "k int")
    run = lambda *n: sorted((r.k, r.v) for r in cache.read_through(keys(*n), compute, path, sign).collect())
    assert run(1, 2, 2) == [(1, 2), (2, 4)] and run(2, 3) == [(2, 4), (3, 6)] and run(1, 2, 3) == [(1, 2), (2, 4), (3, 6)]
    assert asked == [[1, 2], [3]]
    assert cache.stored(spark, path, "0" * 16) is None
    (tmp_path / "cache" / "signature=bad").mkdir()
    assert cache.stored(spark, path, "bad") is None


def test_row_signature(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (1, None, "x")], "a int, b string, c string")
    signs = [r.s for r in df.select(cache.row_signature("c", "a", "b").alias("s")).collect()]
    assert signs[0] == signs[1] != signs[2] and len(signs[0]) == 16


def test_listed_first(spark):
    rows = spark.createDataFrame([("d",), ("a",), ("c",), ("b",)], "t string")
    order = spark.createDataFrame([("c", 0), ("a", 1), ("c", 5), ("z", 2)], "t string, pos int")
    assert [r.t for r in snapshot.in_order(rows, order, "t").orderBy("place").collect()] == ["c", "a", "b", "d"]
    assert [r.t for r in snapshot.in_order(rows, order, "t", 3).orderBy("place").collect()] == ["c", "a", "b"]


def test_readiness(spark):
    expected = spark.createDataFrame([("train", k, f"t{k:02d}") for k in range(20)] + [("val", 0, "v0")], "split string, pos int, token string")
    images = spark.createDataFrame([(f"t{k:02d}",) for k in range(0, 20, 2)] + [("v0",), ("v0",)], "token string")
    annotations = spark.createDataFrame([(f"t{k:02d}", k % 3) for k in range(15)] + [("v0", 2)], "token string, num_lines int")
    rows = readiness.readiness(expected, images, annotations)
    r = rows.filter("split = 'train'").first()
    assert (r.total, r.scanned, r.image_exists, r.annotation_exists, r.annotation_nonempty) == (20, 20, 10, 15, 10)
    assert r.missing_image == ["t01", "t03", "t05", "t07", "t09"] and r.empty_annotation == ["t00", "t03", "t06", "t09", "t12"]
    text, code = readiness.report(rows)
    assert code == 1 and "val: 1 in all" in text and readiness.report(rows.filter("split = 'val'"))[1] == 0
    with pytest.raises(readiness.NotReady, match="missing_annotation: t15"):
        readiness.check(rows)
    readiness.check(rows.filter("split = 'val'"))


def test_predictions_round_trip(spark, tmp_path):
    points = "array<struct<x:double,y:double>>"
    pred = spark.createDataFrame([("s", 1, "curb", 0.5, [(1.0, 2.0)]), ("s", 0, "lane_line", None, [(3.0, 4.0), (5.0, 6.0)])], f"sample string, pred_idx int, category string, score double, points {points}")
    gt = spark.createDataFrame([("s", 0, "curb", [(1.0, 1.0)])], f"sample string, gt_idx int, category string, points {points}")
    records = a.prediction_records(spark.createDataFrame([("s",), ("empty",)], "sample string"), pred, gt)
    a.write_predictions(records, f"{tmp_path}/p")
    got = a.read_predictions(spark, f"{tmp_path}/p", by_line=True).orderBy("pred_idx").collect()
    assert [(r.sample, r.category, r.score, r.fallback, [tuple(p) for p in r.points]) for r in got] == [("s", "lane_line", 1.0, True, [(3.0, 4.0), (5.0, 6.0)]), ("s", "curb", 0.5, False, [(1.0, 2.0)])]
    assert a.read_predictions(spark, f"{tmp_path}/p", "gt", True).count() == 1
    assert {r.token: len(r.pred_lines) for r in records.collect()} == {"s": 2, "empty": 0}


def test_scans(spark, tmp_path):
    one = {"lines": [{"category": "Curb", "points": [[1, 2], [3, 4]]}]}
    (tmp_path / "a.json").write_text(json.dumps({f"{t}_satellite.png": one for t in ("c", "a", "b", "gone")}))
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("other",)], "token string")
    order = spark.createDataFrame([("b", 0)], "token string, pos int")
    place = lambda **k: {r.token: r.place for r in a.scan_annotations(spark, str(tmp_path / "a.json"), images, **k).collect()}
    assert place() == {"a": 0, "b": 1, "c": 2} and place(order=order, most=2) == {"b": 0, "a": 1}
    (tmp_path / "bad.json").write_text("[1, 2]")
    assert a.strict_objects(spark, str(tmp_path / "a.json")).count() == 4
    with pytest.raises(Exception, match="not a JSON object"):
        a.strict_objects(spark, str(tmp_path / "bad.json")).collect()
    for d, n in (("x", "0" * 32), ("y", "0" * 32), ("y", "short")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f"{n}.pkl").write_text("x")
    (r,) = a.list_long_tokens(spark, str(tmp_path)).collect()
    assert r.token == "0" * 32 and r.path.endswith(f"y/{'0' * 32}.pkl")
