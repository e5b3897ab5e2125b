import json

import numpy as np
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.functions import text, tokens
from polyspark.operators import lines, metrics
from polyspark.sources import annotations as a

LINE = "token string, line_idx int, category string, line_type string, points array<struct<x:double,y:double>>"


def one(spark, points, f):
    df = spark.createDataFrame([([tuple(p) for p in points],)], "points array<struct<x:double,y:double>>")
    return [tuple(p) for p in df.select(f(F.col("points")).alias("p")).first().p]


def test_resample_cases(spark):
    assert one(spark, [], lambda p: g.resample(p, 1, 5)) == []
    assert one(spark, [(1.0, 2.0)], lambda p: g.resample(p, 1, 5)) == [(1, 2)]
    assert one(spark, [(1.0, 2.0)] * 3, lambda p: g.resample(p, 1, 5)) == [(1, 2)]
    assert one(spark, [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0)], lambda p: g.resample(p, 2, 9)) == [(0, 0), (2, 0), (4, 0)]
    assert len(one(spark, [(0.0, 0.0), (100.0, 0.0)], lambda p: g.resample(p, 1, 7))) == 7


def test_densify_thin_and_chamfer(spark):
    assert one(spark, [(0.0, 0.0), (3.0, 0.0)], lambda p: g.densify(p, 1)) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert one(spark, [(0.0, 0.0), (0.0, 0.0005), (0.0, 0.002)], g.thin) == [(0, 0), (0, 0.002)]
    df = spark.createDataFrame([([(0.0, 0.0)], [(3.0, 4.0)], [])], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, c array<struct<x:double,y:double>>")
    r = df.select(g.chamfer(F.col("a"), F.col("b")).alias("ab"), g.chamfer(F.col("a"), F.col("c")).alias("ac")).first()
    assert (r.ab, r.ac) == (5.0, 1e6)


def test_serialize_drops_what_is_unusable(spark):
    rows = [("t", 0, "Curb", "Solid", [(0.0, 0.0), (5.0, 5.0)]), ("t", 1, "tree", "Solid", [(0.0, 0.0), (5.0, 5.0)]), ("t", 2, "Lane line", None, [(0.0, 0.0)]), ("t", 3, "curb ", "zig", [(-30.0, 30.0), (float("nan"), 1.0), (1.0, 1.0)]), ("t", 4, "curb", "", None)]
    out = lines.serialize(spark.createDataFrame(rows, LINE)).orderBy("rank").collect()
    assert [(r.rank, r.category, r.line_type, r.start_type) for r in out] == [(1, "curb", "others", "cut"), (2, "curb", "solid", "start")]


def test_names(spark):
    df = spark.createDataFrame([("{-1.5 2.25}", "a_satellite.png"), ("none", "b.png"), (None, None)], "c string, n string")
    lon, lat = text.gps(F.col("c"))
    assert [tuple(r) for r in df.select(lon, lat, text.token_key(F.col("n"))).collect()] == [(-1.5, 2.25, "a"), (None, None, "b"), (None, None, None)]


def test_decoder_stands_garbage(spark):
    v = tokens.Vocabulary()
    x, y = v.first_x, v.first_y
    ids = [1, 9, 7, 11, 8, 99999, -4, x + 1, x + 5, y + 6, y + 7, 9, 7, 8, x, y, 9, 7, 10, 18, 8, x + 1, y + 1, 7, 10, 8, x, y, 2, 9]
    out = tokens.decode(spark.createDataFrame([("t", ids)], "token string, ids array<int>"), v).collect()
    assert [(r.category, [tuple(p) for p in r.points]) for r in out] == [("lane_line", [(5, 6)]), ("curb", [(1, 1)])]


def brute_match(costs, t):
    used, n = set(), 0
    for row in costs:
        free = [(c, j) for j, c in enumerate(row) if j not in used]
        if free and min(free)[0] <= t:
            used.add(min(free)[1])
            n += 1
    return n


def test_greedy_match(spark):
    rng = np.random.default_rng(0)
    c = rng.random((12, 9)).round(2)
    df = spark.createDataFrame([(0, "c", i, i, j, float(c[i, j])) for i in range(12) for j in range(9)], "sample int, category string, ord int, pred_idx int, gt_idx int, cost double")
    for t in (0.05, 0.2, 0.9):
        assert metrics.greedy_match(df, "ord", t).count() == brute_match(c, t)


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"p_satellite.png": {"image_width": 100, "lines": [{"category": "Curb", "points": [[1, 2], [3, 4], [5]]}]}, "bad": 3}))
    r = a.read_annotations(spark, str(tmp_path / "a.json")).collect()
    assert [(x.token, x.image_width, x.image_height, len(x.points)) for x in r] == [("p", 100, 4096, 2)]
    (tmp_path / "g.json").write_text(json.dumps({"p.png": {"gps_center": [1.0, 2.0]}, "q.png": {"gps_center": [1.0]}, "r": {}}))
    assert [(x.token, x.lon, x.image_width) for x in a.read_patch_geometry(spark, str(tmp_path / "g.json")).collect()] == [("p", 1.0, 512)]
    (tmp_path / "s.json").write_text(json.dumps({"train_tokens": ["a", "b"], "val_tokens": ["c"]}))
    assert a.read_splits(spark, str(tmp_path / "s.json")).count() == 3
    (tmp_path / "p.json").write_text(json.dumps([{"token": "t", "pred_lines": [{"category": "curb", "pseudo_score": 0.5, "points": [[1, 2]]}, {"category": "curb", "points": []}]}]))
    assert [(x.score, x.fallback) for x in a.read_predictions(spark, str(tmp_path / "p.json")).orderBy("pred_idx").collect()] == [(0.5, False), (1.0, True)]
    assert a.list_files(spark, str(tmp_path), "*.json").count() == 4
