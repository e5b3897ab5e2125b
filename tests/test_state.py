"""The map's state against plain loops over all lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspark.operators import patch_state as ps
from polyspark.operators import state
from polyspark.operators.linemap import Line, LineMap
from polyspark.plans import states
from polyspark.streaming import scan

SF = "/root/testdata/sf0.001"


def thin(points):
    out = []
    for p in points:
        if not out or np.hypot(*(np.array(p) - out[-1])) > 1e-3:
            out.append(np.array(p, float))
    return out


def brute_merge(lines, radius):
    """Versions ``(order, died, types, points)`` of lines ``(order, types, points)`` by looking at every line of the map."""
    alive, seen, dead = [], set(), []
    for order, kinds, points in lines:
        points, best = [np.array(p, float) for p in points], None
        for k, (_, _, other) in enumerate(alive):
            if len(points) < 2 or len(other) < 2:
                continue
            gaps = [np.hypot(*(other[a] - points[b])) for a, b in ((-1, 0), (0, -1), (-1, -1), (0, 0))]
            if min(gaps) <= radius and (best is None or min(gaps) < best[0]):
                best = (min(gaps), k, gaps.index(min(gaps)))
        if best:
            gone = alive.pop(best[1])
            dead.append((gone[0], order[0], gone[1], gone[2]))
            mine = (kinds, points) if best[2] < 2 else (kinds[::-1], points[::-1])
            a, b = ((gone[1], gone[2]), mine) if best[2] in (0, 2) else (mine, (gone[1], gone[2]))
            head = thin(a[1])
            tail = b[1][1:] if np.hypot(*(head[-1] - b[1][0])) <= 1.5 else b[1]
            kinds, points = (a[0][0], b[0][1]), thin([*head, *tail])
        sign = (tuple(sorted(tuple(np.rint(p)) for p in (points[0], points[-1]))), len(points)) if points else ()
        if sign not in seen:
            seen.add(sign)
            alive.append((order, kinds, points))
    return dead + [(o, None, k, p) for o, k, p in alive]


def plain(rows):
    return sorted((tuple(o), d, tuple(k), [tuple(np.round(np.array(q, float), 6)) for q in p]) for o, d, k, p in rows)


def random_lines(seed, n=120):
    """Short lines whose ends often meet, repeats and single vertices among them."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        p = rng.integers(0, 30, 2).astype(float)
        points = [p + [i * 2, rng.integers(-2, 3)] for i in range(rng.integers(1, 4))]
        out.append(((k // 4, k % 4, k + 1), (f"s{k % 3}", f"e{k % 2}"), points[:: -1 if k % 5 == 0 else 1]))
        if k % 17 == 0:
            out.append(((k // 4, k % 4, k + 1000), out[-1][1], out[-1][2]))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_what_a_loop_finds(seed):
    lines = random_lines(seed)
    index, dead = LineMap(3.0), []
    for order, kinds, points in lines:
        _, gone = index.add(Line(order, np.array(points).reshape(-1, 2), kinds))
        if gone:
            dead.append((gone.order, order[0], gone.kinds, gone.points))
    got = dead + [(x.order, None, x.kinds, x.points) for x in index.lines.values()]
    assert plain(got) == plain(brute_merge(lines, 3.0)) and len(dead) > 5


@pytest.mark.parametrize("old, new, want, types", [
    ([(0, 0), (10, 0)], [(11, 0), (20, 0)], [(0, 0), (10, 0), (20, 0)], ("a", "d")),
    ([(11, 0), (20, 0)], [(0, 0), (10, 0)], [(0, 0), (10, 0), (20, 0)], ("c", "b")),
    ([(0, 0), (10, 0)], [(20, 0), (11, 0)], [(0, 0), (10, 0), (20, 0)], ("a", "c")),
    ([(10, 0), (0, 0)], [(11, 0), (20, 0)], [(20, 0), (11, 0), (0, 0)], ("d", "b")),
])
def test_each_direction_hands_its_types_on(old, new, want, types):
    index = LineMap(3.0)
    index.add(Line((0,), np.array(old, float), ("a", "b")))
    born, gone = index.add(Line((1,), np.array(new, float), ("c", "d")))
    assert [tuple(p) for p in born.points] == want and born.kinds == types and gone.order == (0,)


def as_rows(df):
    return sorted(((r.scene, r.category, r.line_type, r.pos, r["rank"], r.died, r.start_type, r.end_type, [(round(p.x, 6), round(p.y, 6)) for p in r.points]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def scanned(spark):
    patches, lines = states.scan_input(spark, SF)
    patches, lines = patches.cache(), lines.cache()
    seen, counts, versions = ps.state_scan(patches, lines, states.SCAN)
    return patches, lines, seen.cache(), counts.cache(), versions.cache()


def test_versions_of_the_scan(spark, scanned):
    patches, lines, _, _, versions = scanned
    rows = ps.to_global(lines, patches, states.SCAN).join(patches.select("token", "scene", "pos"), "token").collect()
    kinds = {}
    for r in sorted(rows, key=lambda r: (r.pos, r["rank"])):
        kinds.setdefault((r.scene, r.category, r.line_type), []).append(((r.pos, r["rank"]), (r.start_type, r.end_type), [(p.x, p.y) for p in r.points]))
    want = [(*k, *o, d, *t, [(round(float(x), 6), round(float(y), 6)) for x, y in p]) for k, v in kinds.items() for o, d, t, p in brute_merge(v, 3.0)]
    assert as_rows(versions) == sorted(want, key=repr)
    assert versions.filter("died IS NOT NULL").count() > 0


def test_state_is_what_the_map_was(spark, scanned):
    """Patch by patch: the map of the patches before it, projected by itself, gives the patch's state."""
    patches, lines, seen, counts, versions = scanned
    placed = patches.filter("x IS NOT NULL")
    some = sorted(r.token for r in placed.collect() if r.pos > 24)[::12]
    key = lambda r: (r["rank"], r.traced, r.category, r.line_type, r.start_type, r.end_type, [(round(p.x, 6), round(p.y, 6)) for p in r.points])
    found = 0
    for token in some:
        one = placed.filter(F.col("token") == token)
        p = one.first()
        rows = ps.to_global(lines, patches, states.SCAN).join(placed.select("token", "scene", "pos"), "token")
        before = state.map_versions(rows.filter((F.col("scene") == p.scene) & (F.col("pos") < p.pos))).filter("died IS NULL")
        before = before.withColumns({"line": F.struct("category", "line_type", "pos", "rank", "seq"), "ord": F.struct("pos", "rank", "seq")})
        want, stats = ps.state_lines(one.drop("pos", "scene"), before.drop("pos", "rank", "seq", "died", "scene"), states.SCAN)
        got = sorted(map(key, seen.filter(F.col("token") == token).collect()))
        assert got == sorted(map(key, want.collect()))
        assert stats.first() == counts.filter(F.col("token") == token).first()
        found += len(got)
    assert found > 0
    # patches without a place show the lines of the patch before
    lost = patches.filter("x IS NULL").join(lines.select(F.col("token").alias("prev"), F.lit(1).alias("has")), "prev").groupBy("token").count()
    assert {r.token: r["count"] for r in lost.collect()} == {r.token: r["count"] for r in seen.join(lost.select("token"), "token").groupBy("token").count().collect()}


def test_stream_gives_the_versions_of_the_batch(spark, scanned, tmp_path):
    """Three batches in scan order; the events make up the same versions, and so the same states."""
    patches, lines, _, _, versions = scanned
    rows = ps.to_global(lines, patches, states.SCAN).join(patches.select("token", "scene", "pos"), "token").filter("scene IN ('s0', 's1')").cache()
    source, number = f"{tmp_path}/in", []
    for k, part in enumerate(("pos < 40", "pos >= 40 AND pos < 80", "pos >= 80")):
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = scan.start_scan(stream, f"{tmp_path}/events", f"{tmp_path}/checkpoint", each=lambda s, n: number.append(n))
        q.awaitTermination(300)
        assert q.exception() is None
    events = spark.read.parquet(f"{tmp_path}/events")
    assert as_rows(scan.versions_of(events)) == as_rows(versions.filter("scene IN ('s0', 's1')"))
    assert len(set(number)) == 3


def test_project_without_any_line(spark):
    patches, lines = states._patches(spark, SF), states._global(spark, SF).limit(0)
    out, counts = ps.state_lines(patches, lines, states.VIEW)
    assert out.count() == 0 and counts.filter("num_state_lines = 0").count() == patches.count()


def test_cut_points(spark):
    """One vertex of each cut end, near the window, on its border."""
    patch = [("t", 0.0, 0.0, 64, 64, 0, 0, 64, 64, "")]
    patches = spark.createDataFrame(patch, "token string, x double, y double, image_width int, image_height int, x_min int, y_min int, x_max int, y_max int, original_image string")
    view = ps.View(size=64, metres=1.0, endpoint=5.0)
    rows = [(k, k, "curb", "", a, b, [tuple(p) for p in pts], None, None) for k, (a, b, pts) in enumerate([
        ("cut", "cut", [(-34.0, 0.0), (0.0, 0.0)]), ("cut", "end", [(-60.0, 0.0), (0.0, 0.0)]), ("start", "cut", [(0.0, 0.0), (0.0, 31.0)])
    ])]
    lines = spark.createDataFrame(rows, f"line int, ord int, category string, line_type string, start_type string, end_type string, points {state.POINTS}, source_points {state.POINTS}, source_image string")
    got = ps.cut_points(patches.crossJoin(lines), view).collect()
    assert [[tuple(p) for p in r.points] for r in got] == [[(0.0, 31.5)], [(31.5, 0.5)]]


def shared_input(spark):
    """Patches of four crops of two images and some without one; lines met by both ways, and lines whose source pixels are not their vertices'."""
    rng = np.random.default_rng(3)
    patches = [(f"t{k}", float(rng.integers(-20, 20)), float(rng.integers(-20, 20)), 16, 16, (k % 2) * 10, 0, (k % 2) * 10 + 16, 16, ("", "a", "b")[k % 3]) for k in range(60)]
    lines = []
    for k in range(80):
        pts = [(float(x), float(y)) for x, y in rng.uniform(-20, 20, (5, 2))]
        source = [(x + 10, y + 10) for x, y in pts][: 3 if k % 9 == 0 else 5]
        lines.append((k, k, "curb", "ab"[k % 2], "cut" if k % 3 else "start", "cut" if k % 2 else "end", pts, source if k % 11 else None, "ab"[k % 2]))
    return (
        spark.createDataFrame(patches, "token string, x double, y double, image_width int, image_height int, x_min int, y_min int, x_max int, y_max int, original_image string"),
        spark.createDataFrame(lines, f"line long, ord long, category string, line_type string, start_type string, end_type string, points {state.POINTS}, source_points {state.POINTS}, source_image string"),
    )


@pytest.mark.parametrize("margin, overlap", [(2.0, 4.0), (6.0, 1.0)])
def test_patches_of_a_crop_share_their_work(spark, margin, overlap):
    """What a crop and a patch see apart is what all pairs give; a crop's lines are paired once, however many patches have it."""
    patches, lines = shared_input(spark)
    view = ps.View(size=64, metres=0.1, max_lines=4, overlap=overlap, endpoint=6.0, step=4.0, source_margin=margin, radius=3.0)
    near = state.near_patch(patches, lines, margin, 3.0).cache()
    pairs = ps.pair_up(patches, lines, near).cache()
    seen = ps.Seen(patches, lines, view)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(seen.near().select("token", "line")) == rows(near.select("token", "line"))
    assert rows(seen.candidates()) == rows(near.groupBy("token").agg(F.count("*").alias("n")))
    assert rows(seen.traces()) == rows(ps.cut_traces(pairs, view)) != []
    want = ps._projected(pairs, ps.View(**{**vars(view), "max_lines": 1000})).filter("n <= 4").select("token", "n", *ps._SHOWN)
    assert rows(seen.projected()) == rows(want) != []
    assert seen.by_crop.count() + seen.by_patch.count() < near.count() / 2


def test_versions_project_nothing(spark, monkeypatch):
    """The query of the versions merges the map and does not show it to every patch."""
    want = as_rows_of_query(ps.state_scan(*states.scan_input(spark, SF), states.SCAN)[2])
    monkeypatch.setattr(ps, "state_lines", lambda *a, **b: pytest.fail("projected"))
    assert as_rows_of_query(states.map_versions(spark, SF)) == want


def as_rows_of_query(versions):
    return sorted(map(repr, versions.select("scene", "pos", "rank", "died", "category", "line_type").collect()))


def end_rows(spark, rng, n, first):
    rows = [(first + k, "c", "ab"[k % 2], [tuple(map(float, p)) for p in rng.integers(0, 40, (3, 2))]) for k in range(n)]
    return rows, spark.createDataFrame(rows, f"line long, category string, line_type string, points {state.POINTS}")


def test_nearest_end_by_growing_cells(spark, monkeypatch):
    """Small cells first give the same nearest ends, ties included, and a line looks again only where it found nothing."""
    monkeypatch.setattr(state, "FEW_ENDS", 1)
    looks, within = [], state._nearest_within
    monkeypatch.setattr(state, "_nearest_within", lambda n, b, r: looks.append((r, n.count())) or within(n, b, r))
    rng = np.random.default_rng(1)
    (new, a), (base, b) = end_rows(spark, rng, 150, 0), end_rows(spark, rng, 150, 1000)
    want = set()
    for n in new:
        best = [(float(np.hypot(*np.subtract(p[-u], q[-v]))), m, w) for m, _, t, p in base if t == n[2] for q in (n[3],) for w, (u, v) in enumerate(((1, 3), (3, 1), (1, 1), (3, 3)))]
        best = min(x for x in best)
        if best[0] <= 8.0:
            want.add((n[0], best[1], best[2], round(best[0], 9)))
    assert {(r.line, r.base, r.way, round(r.dist, 9)) for r in state.nearest_end(a, b, 8.0).collect()} == want
    assert len(looks) > 3 and looks[-1][0] == 8.0 and looks[-1][1] < looks[0][1]


def test_merged_map_gives_no_dead_version(spark, monkeypatch):
    """The merged map is the live versions, from a merge that hands on no version that was taken up, a few points at a time."""
    rows = [("s", *o[:2], "c", "t", *kinds, [tuple(map(float, p)) for p in pts]) for o, kinds, pts in random_lines(2)]
    df = spark.createDataFrame(rows, f"scene string, pos long, rank int, category string, line_type string, start_type string, end_type string, points {state.POINTS}")
    made = state._versions(3.0, died=False)
    data = df.withColumns({"source_points": F.lit(None).cast(state.POINTS), "source_image": F.lit(None).cast("string")}).orderBy("pos", "rank").toPandas()
    monkeypatch.setattr(state, "FRAME_POINTS", 5)
    frames = list(made(iter([data])))
    assert all(f.died.isna().all() for f in frames) and max(sum(map(len, f.points)) - len(f.points.iloc[-1]) for f in frames) <= 5
    every = state.map_versions(df, 3.0)
    assert every.filter("died IS NOT NULL").count() > 0
    assert sum(map(len, frames)) == every.filter("died IS NULL").count() == state.merge_maps(df, 3.0).count()


def test_frames_look_at_old_lines_first(spark):
    """Rounds by age give what each frame sees of all lines before it; frames that have enough look no further."""
    from polyspark.operators import ego_scan as ego

    frames, lines = states._frames(spark, "/root/testdata/sf0.01")
    known = ego.first_seen(ego.to_world(lines, frames)).cache()
    assert len(ego._ages(known, 1)) > 1 and ego._ages(known, 1000) == []
    got = ego.seen_before(frames, known, 224, 2, 10.0)
    all_at_once = ego.seen_before(frames, known, 224, 1000, 10.0)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(all_at_once.filter("rank <= 2")) != []


def test_pairs_of_one_crop_are_dealt_to_many_tasks(spark):
    of = spark.createDataFrame([(f"p{i}", ("tile", i % 50 // 49)) for i in range(400)], "token string, crop struct<name: string, k: int>")
    near = spark.createDataFrame([(("tile", k), n) for k in (0, 1, 2) for n in range(30 + k)], "crop struct<name: string, k: int>, line long")
    out = ps.dealt(of, near, 500)
    want = {(f"p{i}", n) for i in range(400) for n in range(30 + i % 50 // 49)}
    got = [(r.token, r.line) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < len(want) / 4


def test_projection_in_batches_is_that_of_expressions(spark):
    """Densified, cut, clamped and thinned as by the functions of geometry, to the last bit: nulls, single vertices, repeats, corners and both kinds of windows."""
    from polyspark.functions import geometry as g

    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        pts = [(float(x), float(y)) for x, y in rng.uniform(-9, 9, (k % 7, 2)).round(k % 3)]
        pts = [p for p in pts for _ in range(1 + k % 2)] + ([(None, 1.0), (2.0, float("nan"))] if k % 13 == 0 else [])
        source = [(None if x is None else x + 8, y + 8) for x, y in pts]
        rows.append((f"t{k % 5}", k, "curb", "", float(k % 3), -1.0, 16, 20, 2, 2, 14, 14, "a" if k % 5 < 2 else "", None if k % 11 == 0 else pts, source, "a" if k % 2 else "b"))
    kinds = "token string, ord long, category string, line_type string, x double, y double, image_width int, image_height int, x_min int, y_min int, x_max int, y_max int, original_image string"
    pairs = spark.createDataFrame(rows, f"{kinds}, points {state.POINTS}, source_points {state.POINTS}, source_image string")
    view = ps.View(size=64, metres=0.5, max_lines=1000, overlap=6.0, step=0.7)
    m, hi, same = view.overlap, 63.0, ps._same_image()
    dense = F.when(same, g.densify(F.col("source_points"), 2.0)).otherwise(g.densify(F.col("points"), view.step))
    rows = pairs.withColumn("dense", dense).withColumn("pixels", F.when(same, ps._on_crop(F.col("dense"), view)).otherwise(ps._on_patch(F.col("dense"), view)))
    in_crop = F.transform("dense", lambda p: ps._within(p, F.col("x_min") - m, F.col("x_max") + m, F.col("y_max") + m, F.col("y_min") - m))
    rows = rows.withColumn("inside", F.when(same, in_crop).otherwise(F.transform("pixels", lambda p: ps._within(p, -m, hi + m, hi + m)))).filter(F.array_contains("inside", True))
    start = F.greatest(F.array_position("inside", True) - 3, F.lit(0)).cast("int")
    end = F.least(F.size("inside") - F.array_position(F.reverse("inside"), True) + 2, F.size("inside") - 1).cast("int")
    rows = rows.withColumns({"a": start, "z": end}).withColumn("run", g.thin(g.clip(F.slice("pixels", F.col("a") + 1, F.col("z") - F.col("a") + 1), 0.0, hi)))
    border = lambda p: g.on_border(p, 64, view.border)
    kinds = F.when((F.col("a") > 0) | border(F.get("run", F.lit(0))), "cut").otherwise("start"), F.when((F.col("z") < F.size("pixels") - 1) | border(F.element_at("run", -1)), "cut").otherwise("end")
    want = rows.select("token", "ord", kinds[0].alias("start_type"), kinds[1].alias("end_type"), F.col("run").alias("points"))
    got = ps._projected(pairs, view).select("token", "ord", "start_type", "end_type", "points")
    shown = lambda df: sorted((r.token, r.ord, r.start_type, r.end_type, tuple(map(tuple, r.points))) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(want)) > 100
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_leading_pairs_leave_no_first_line_out(spark):
    """Whatever is behind enough certain lines goes before anything is densified; the first lines stay the same."""
    patches, lines = shared_input(spark)
    view = ps.View(size=64, metres=0.1, max_lines=3, overlap=4.0, step=4.0, source_margin=2.0, radius=3.0)
    pairs = ps.pair_up(patches, lines, state.near_patch(patches, lines, 2.0, 3.0)).cache()
    leading = ps.pair_up(patches, lines, ps._leading(pairs, view)).cache()
    rows = lambda df: sorted(map(repr, ps.project(df, view).collect()))
    assert rows(leading) == rows(pairs) != []
    assert leading.count() < pairs.count()
