"""The dataset builder against plain loops, and batches."""

import math

from pyspark.sql import functions as F

from polyspark.functions import text, tokens
from polyspark.operators import batches
from polyspark.operators import dataset as ds

AUG = ds.Augmentation(rotations=(90.0, 0.0, 30.0), offsets=((0, 0), (-8, 4), (100, 0)), inclines=(15.0, -10.0))
BASE = "token string, image_width int, source_image string, source_split string, city string, center_x int, center_y int, x_min int, y_min int, x_max int, y_max int, lon double, lat double, lines " + ds.LINES


def lines_of(seed, n, size):
    return [("curb" if k % 2 else "lane_line", "solid", [(float((seed * 7 + k * 5 + i * 3) % size), float((seed * 3 + k * 11 + i * 4) % size)) for i in range(k % 4)]) for k in range(n)]


def rotate(p, cx, cy, deg):
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    return cx + (p[0] - cx) * c - (p[1] - cy) * s, cy + (p[0] - cx) * s + (p[1] - cy) * c


def expected(base, raws, bounds, names):
    """``token: (split, kind, parent, crop, place, lines)``, and counters."""
    tokens_ = sorted(b[0] for b in base if b[0] in names)
    n_val = min(max(1, round(len(tokens_) * 0.2)), len(tokens_) - 1)
    split = {t: "val" if k >= len(tokens_) - n_val else "train" for k, t in enumerate(tokens_)}
    out, count = {}, {}
    clamp = lambda v, w: max(0.0, min(float(w), v))

    def put(token, kind, parent, box, place, lines):
        out[token] = (split[parent], kind, parent, box, place, [(c, t, [(round(x, 6), round(y, 6)) for x, y in p]) for c, t, p in lines])
        count[f"{split[parent]}_{kind}"] = count.get(f"{split[parent]}_{kind}", 0) + 1

    def turned(lines, w, deg):
        return [(c, t, [(clamp(x, w), clamp(y, w)) for x, y in (rotate(q, w / 2, w / 2, deg) for q in p)]) for c, t, p in lines if len(p) >= 2]

    for token, w, image, _, _, cx, cy, x0, y0, x1, y1, lon, lat, lines in base:
        if token not in names:
            continue
        box, place = (x0, y0, x1, y1), (lon, lat)
        put(token, "base", token, box, place, lines)
        if split[token] == "val":
            continue
        for a in (90.0, 30.0):
            put(f"{token}__rot{round(a):03d}", "rotation", token, box, place, turned(lines, w, a))
        if image not in raws:
            continue
        rw, rh, raw = raws[image]
        crops = [("overlap", f"__ovp_x{dx:+d}_y{dy:+d}", dx, dy, 0.0) for dx, dy in ((-8, 4), (100, 0))] + [("inclined", f"__inc_{round(a):03d}", 0, 0, a) for a in (15.0, -10.0)]
        for kind, suffix, dx, dy, a in crops:
            mx, my = cx + dx, cy + dy
            left, top = round(mx - w / 2), round(my - w / 2)
            if left < 0 or top < 0 or left + w > rw or top + w > rh:
                count[f"skip_{kind}_out_of_bounds"] = count.get(f"skip_{kind}_out_of_bounds", 0) + 1
                continue
            cut = []
            for c, t, p in raw:
                near = [(x - left, y - top) for x, y in (rotate(q, mx, my, a) for q in p)] if len(p) >= 2 else []
                near = [(clamp(x, w), clamp(y, w)) for x, y in near if -10 <= x <= w + 10 and -10 <= y <= w + 10]
                if len(near) >= 2:
                    cut.append((c, t, near))
            place = (None, None)
            if image in bounds:
                (a0, a1), (b0, b1) = bounds[image]
                place = (a0 + mx / (rw - 1) * (a1 - a0), b0 + (1 - my / (rh - 1)) * (b1 - b0))
            box = (left, top, left + w, top + w)
            put(token + suffix, kind, token, box, place, cut)
            for turn in (90.0, 30.0):
                put(f"{token}{suffix}__rot{round(turn):03d}", f"{kind}_rotation", token, box, place, turned(cut, w, turn))
    return out, count


def test_five_tables(spark):
    base = [(f"p{k:02d}", 40, f"t{k % 3}", "train", "c", 10 + k * 9 % 100, 15 + k * 13 % 90, k, k, k + 40, k + 40, None if k % 4 == 0 else k / 10, k / 20, lines_of(k, 6, 40)) for k in range(17)]
    raws = {f"t{k}": (120, 110, lines_of(k + 50, 30, 110)) for k in range(2)}
    names = [b[0] for b in base if b[0] != "p05"] + ["unknown"]
    grid = [("t0", x / 10, y / 5) for x in range(5) for y in (0, 1, 3)] + [("t2", 1.0, 1.0), ("t0", None, None)]
    bounds = {"t0": ((-0.05, 0.45), (-0.15, 0.75)), "t2": ((1.0, 1.0), (1.0, 1.0))}
    raw = spark.createDataFrame([(k, *v) for k, v in raws.items()], "source_image string, raw_width int, raw_height int, raw_lines " + ds.LINES)
    tiles = ds.tile_bounds(spark.createDataFrame(grid, "image string, lon double, lat double"))
    rows = ds.samples(spark.createDataFrame(base, BASE).repartition(3), spark.createDataFrame([(n,) for n in names], "token string"), raw, tiles, AUG, ["token"])
    got = ds.build(rows, ["token"])
    want, count = expected(base, raws, bounds, names)
    manifest = {r.token: (r.split, r.kind, r.parent, r.num_lines) for r in got["manifest"].collect()}
    assert manifest == {t: (s, k, p, len(x)) for t, (s, k, p, _, _, x) in want.items()}
    lines = {}
    for r in got["annotations"].orderBy("token", "line_idx").collect():
        lines.setdefault(r.token, []).append((r.category, r.line_type, [(round(p.x, 6), round(p.y, 6)) for p in r.points]))
    assert lines == {t: v[5] for t, v in want.items() if v[5]}
    places = {r.token: (round(r.lon, 9), round(r.lat, 9), r.crop_region.x_min, r.crop_region.y_min, r.crop_region.x_max, r.crop_region.y_max) for r in got["patch_geometry"].collect()}
    assert places == {t: (round(v[4][0], 9), round(v[4][1], 9), *v[3]) for t, v in want.items() if None not in v[4]}
    order = {s: [r.token for r in got["splits"].filter(F.col("split") == s).orderBy("pos").collect()] for s in ("train", "val")}
    assert order == {s: sorted(t for t, v in want.items() if v[0] == s) for s in ("train", "val")}
    totals = {"num_base_tokens": 16, "num_annotations": len(want), "num_patch_geometry": len(places)}
    assert ds.summary_of(got["summary"].collect()) == count | totals
    assert count["skip_overlap_out_of_bounds"] > 0


def test_spec_is_the_product(spark):
    rows = AUG.spec(spark).collect()
    assert len(rows) == (1 + 2 + 2) * 3 and len({r.suffix for r in rows}) == 15
    assert {r.kind for r in rows} == {"base", "rotation", "overlap", "overlap_rotation", "inclined", "inclined_rotation"}


def test_batches(spark):
    rows = [(k, list(range(1, 2 + k * 5 % 11)), min(k % 4, k * 5 % 11)) for k in range(25)]
    df = batches.pack(spark.createDataFrame(rows, "k int, ids array<int>, start int").repartition(5), "ids", ["k"], 4)
    out = batches.pad(batches.loss_mask(df), {"ids": 0}).collect()
    order = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    for r in out:
        n = next(i for i, x in enumerate(order) if x[0] == r.k)
        ids, start = order[n][1:]
        width = max(len(x[1]) for x in order[n // 4 * 4 : n // 4 * 4 + 4])
        assert (r.batch, r.slot) == divmod(n, 4)
        assert r.ids == ids + [0] * (width - len(ids)) and r.ids_mask == [1] * len(ids) + [0] * (width - len(ids))
        assert r.loss_mask == [max(0, start - 1) <= j < len(ids) - 1 for j in range(width - 1)]
    one = {r.batch: r.ids for r in batches.collate(batches.pad(df, {"ids": 0}), ["ids"]).collect()}
    assert len(one) == 7 and all(len({len(x) for x in b}) == 1 for b in one.values())


def test_prefix_and_prompt_cases(spark):
    v = tokens.Vocabulary()
    line = "struct<category:string,line_type:string,start_type:string,end_type:string,points:array<struct<x:double,y:double>>>"
    lines = [("curb", "", "cut", "cut", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]), ("curb", "", "start", "end", [(9.0, 9.0)]), ("curb", "", "cut", "end", [])]
    df = spark.createDataFrame([(lines, [(0.0, 0.0)], None, [(0.0, 0.0), (0.0, -10.0)])], f"l array<{line}>, short array<struct<x:double,y:double>>, none array<struct<x:double,y:double>>, up array<struct<x:double,y:double>>")
    r = df.select(
        tokens.state_prefix(F.col("l"), "cut_points", 9).alias("points"), tokens.state_prefix(F.slice("l", 2, 1), "cut_points", 9).alias("spare"),
        tokens.trace_prompt(F.col("short"), v).alias("short"), tokens.trace_prompt(F.col("none"), v).alias("none"), tokens.trace_prompt(F.col("up"), v).alias("up"),
        tokens.text_prompt(F.col("none"), "target_xy", v).alias("xy"), tokens.text_prompt(F.col("up"), "full_map", v).alias("full"), text.prompt_text("{state_instruction} {x}", None, {"x": 1}).alias("prompt"),
    ).first()
    assert [[tuple(p) for p in x.points] for x in r.points] == [[(1.0, 2.0)], [(5.0, 6.0)]] and len(r.spare) == 1
    assert r.short == r.none == [5, 6] and r.xy == [4, 6] and r.full == [6]
    assert r.up == [5, 22, 246, 470 + round(90 * 359 / 360), 22, 246, 470 + round(90 * 359 / 360), 6]
    assert r.prompt == f"{text.NO_STATE_USED} 1"


def test_tables_without_lines(spark):
    """Splits, geometry, summary and manifest from patches and lines apart are those of samples with lines; no row holds the lines of a raw image."""
    base = [(f"p{k:02d}", 40, f"t{k % 3}", "train", "c", 20 + k % 4 * 10, 25 + k % 4 * 9, k, k, k + 40, k + 40, None if k % 4 == 0 else k / 10, k / 20, lines_of(k, k % 6, 40)) for k in range(17)]
    raw = spark.createDataFrame([(f"t{k}", 120, 110, lines_of(k + 50, 30, 110)) for k in range(2)], "source_image string, raw_width int, raw_height int, raw_lines " + ds.LINES)
    base, names = spark.createDataFrame(base, BASE), spark.createDataFrame([(b[0],) for b in base[1:]], "token string")
    bounds = ds.tile_bounds(spark.createDataFrame([("t0", 0.0, 0.0), ("t0", 1.0, 1.0)], "image string, lon double, lat double"))
    want = ds.build(ds.samples(base, names, raw, bounds, AUG, ["token"]), ["token"])
    given = (names, raw.drop("raw_lines"))
    rows = ds.places(base.drop("lines"), *given, bounds, AUG, ["token"])
    own = base.select("token", F.explode("lines").alias("l")).select("token", "l.points")
    counts = ds.counted(base.drop("lines"), own, *given, raw.select("source_image", F.explode("raw_lines").alias("l")).select("source_image", "l.points"), bounds, AUG, ["token"])
    got = {"splits": ds.splits(rows, ["token"]), "patch_geometry": ds.patch_geometry(rows), "summary": ds.summary(rows), "manifest": ds.manifest(counts)}
    plain = lambda df: sorted(map(repr, df.collect()))
    assert {k: plain(v) for k, v in got.items()} == {k: plain(want[k]) for k in got}
    assert want["manifest"].filter("num_lines = 0").count() > 0 and "lines" not in rows.columns + counts.columns
