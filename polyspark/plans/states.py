"""Queries of the map's state: customers as patches, embeddings as global lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.operators import ego_scan as ego
from polyspark.operators import patch_state as ps
from polyspark.operators.stages import settled
from polyspark.plans import fixtures as fx
from polyspark.plans.registry import query

VIEW = ps.View(size=64, metres=0.1, max_lines=6, border=4.0, overlap=4.0, endpoint=6.0, step=4.0, trace=3, source_margin=2.0, radius=0.5)
SIDE = 16


def _patches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    low_x, low_y = k % 8 * 10, F.floor(k / 8) % 8 * 10
    return fx.table(spark, d, "customer").select(
        F.concat(F.lit("cust_"), k).alias("token"), ((k % 40 - 20) * 3.0).alias("x"), ((F.floor(k / 40) - 20) * 3.0).alias("y"), F.lit(SIDE).alias("image_width"), F.lit(SIDE).alias("image_height"),
        low_x.alias("x_min"), low_y.alias("y_min"), (low_x + SIDE).alias("x_max"), (low_y + SIDE).alias("y_max"),
        F.when(k % 16 == 0, F.concat(F.lit("tile_"), F.floor(k / 16) % 5)).otherwise("").alias("original_image"),
    )


def _global(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    source = F.transform("points", lambda p: F.struct(((p["x"] + 20) * 2.5).alias("x"), ((p["y"] + 20) * 2.5).alias("y")))
    return fx.lines(spark, d).select(
        v.alias("line"), v.alias("ord"), "category", "line_type", F.when(v % 3 == 0, "cut").otherwise("start").alias("start_type"), F.when(v % 4 == 0, "cut").otherwise("end").alias("end_type"),
        "points", source.alias("source_points"), F.concat(F.lit("tile_"), v % 5).alias("source_image"),
    )


def _dense(points: str, step: float) -> str:
    seg = f"greatest(ceil(sqrt(({points}[i + 1].x - {points}[i].x) ** 2 + ({points}[i + 1].y - {points}[i].y) ** 2) / {step}::DOUBLE), 1)::BIGINT"
    at = lambda c: f"{points}[i].{c} + ({points}[i + 1].{c} - {points}[i].{c}) * k / {seg}"
    return f"flatten(list_transform(range(1, 32), lambda i: list_transform(range(0, {seg}), lambda k: {{'x': {at('x')}, 'y': {at('y')}}}))) || [{points}[32]]"


_R = f"({VIEW.size - 1}.0::DOUBLE / {SIDE - 1})"
_MID = f"{(SIDE - 1) / 2}::DOUBLE"
_HI = f"{VIEW.size - 1}.0::DOUBLE"
_STATE = f"""WITH {fx.LINES}, p AS (
  SELECT 'cust_' || c_custkey AS token, (c_custkey % 40 - 20) * 3.0::DOUBLE AS x, (c_custkey // 40 - 20) * 3.0::DOUBLE AS y, c_custkey % 8 * 10 AS x_min, c_custkey // 8 % 8 * 10 AS y_min,
         CASE WHEN c_custkey % 16 = 0 THEN 'tile_' || (c_custkey // 16 % 5) ELSE '' END AS original_image FROM customer
), g0 AS (
  SELECT vec_id AS line, category, line_type, CASE WHEN vec_id % 3 = 0 THEN 'cut' ELSE 'start' END AS start_type, CASE WHEN vec_id % 4 = 0 THEN 'cut' ELSE 'end' END AS end_type, points,
         list_transform(points, lambda p: {{'x': (p.x + 20) * 2.5::DOUBLE, 'y': (p.y + 20) * 2.5::DOUBLE}}) AS src, 'tile_' || (vec_id % 5) AS source_image FROM lines
), g AS (SELECT *, {_dense('points', VIEW.step)} AS far, {_dense('src', max(1.0, 1 / VIEW.metres))} AS near FROM g0
), v AS (SELECT line, source_image, unnest(points) AS a, unnest(src) AS b FROM g), cand AS (
  SELECT DISTINCT token, line FROM p JOIN v ON sqrt((v.a.x - p.x) * (v.a.x - p.x) + (v.a.y - p.y) * (v.a.y - p.y)) <= {VIEW.radius}
  UNION
  SELECT DISTINCT token, line FROM p JOIN v ON p.original_image = v.source_image
    AND v.b.x BETWEEN x_min - {VIEW.source_margin} AND x_min + {SIDE} + {VIEW.source_margin} AND v.b.y BETWEEN y_min - {VIEW.source_margin} AND y_min + {SIDE} + {VIEW.source_margin}
), pairs AS (SELECT *, g.source_image = p.original_image AS same FROM cand JOIN p USING (token) JOIN g USING (line))"""


def _at(points_near: str, points_far: str, a: str = "q") -> str:
    near = f"list_transform({points_near}, lambda {a}: {{'x': ({a}.x - x_min) * {_R}, 'y': ({a}.y - y_min) * {_R}}})"
    far = f"list_transform({points_far}, lambda {a}: {{'x': (({a}.x - x) / {VIEW.metres}::DOUBLE + {_MID}) * {_R}, 'y': ({_MID} - ({a}.y - y) / {VIEW.metres}::DOUBLE) * {_R}}})"
    return f"CASE WHEN same THEN {near} ELSE {far} END"


def _window(q: str, m: float) -> str:
    return f"{q}.x >= -{m} AND {q}.x <= {_HI} + {m} AND {q}.y >= -{m} AND {q}.y <= {_HI} + {m}"


def _edge(q: str, tol: float) -> str:
    return f"({q}.x <= {tol} OR {q}.y <= {tol} OR {q}.x >= {_HI} - {tol} OR {q}.y >= {_HI} - {tol})"


_CLAMP = f"{{'x': least({_HI}, greatest(0.0::DOUBLE, q.x)), 'y': least({_HI}, greatest(0.0::DOUBLE, q.y))}}"
_M = VIEW.overlap
_PROJECTED = f"""pix AS (SELECT *, {_at('near', 'far')} AS pix FROM pairs
), flag AS (SELECT *, CASE WHEN same THEN list_transform(near, lambda q: q.x >= x_min - {_M} AND q.x <= x_min + {SIDE} + {_M} AND q.y >= y_min - {_M} AND q.y <= y_min + {SIDE} + {_M})
  ELSE list_transform(pix, lambda q: {_window('q', _M)}) END AS ins FROM pix
), cut AS (SELECT *, greatest(list_position(ins, true) - 2, 1) AS a, least(len(ins) + 3 - list_position(list_reverse(ins), true), len(ins)) AS z FROM flag WHERE list_contains(ins, true)
), run AS (
  SELECT *, list_reduce(list_transform(list_transform(pix[a:z], lambda q: {_CLAMP}), lambda q: [q]), lambda s, q: CASE WHEN sqrt((s[-1].x - q[1].x) ** 2 + (s[-1].y - q[1].y) ** 2) > 1e-3::DOUBLE THEN list_concat(s, q) ELSE s END) AS run FROM cut
), projected AS (
  SELECT token, row_number() OVER (PARTITION BY token ORDER BY line) AS n, category, line_type, CASE WHEN a > 1 OR {_edge('run[1]', VIEW.border)} THEN 'cut' ELSE 'start' END AS start_type,
         CASE WHEN z < len(pix) OR {_edge('run[len(run)]', VIEW.border)} THEN 'cut' ELSE 'end' END AS end_type, run AS points FROM run QUALIFY n <= {VIEW.max_lines}
)"""
_ENDPOINT = VIEW.endpoint
_NEAR = " OR ".join(f"abs(q.{c} - {c}_min) <= {_ENDPOINT} OR abs(q.{c} - {c}_min - {SIDE}) <= {_ENDPOINT}" for c in "xy")
_TRACES = f"""ends AS (
  SELECT * EXCLUDE (near, far), 0 AS side, points[1:3] AS e, src[1:3] AS se FROM pairs WHERE start_type = 'cut'
  UNION ALL SELECT * EXCLUDE (near, far), 1, list_reverse(points[30:32]), list_reverse(src[30:32]) FROM pairs WHERE end_type = 'cut'
), tp AS (SELECT *, {_at('se', 'e')} AS pix FROM ends
), tn AS (SELECT *, list_transform(pix, lambda q: {_CLAMP}) AS t FROM tp WHERE CASE WHEN same THEN len(list_filter(se, lambda q: {_NEAR})) > 0 ELSE len(list_filter(pix, lambda q: {_window('q', _ENDPOINT)})) > 0 END
), traces AS (
  SELECT token, row_number() OVER (PARTITION BY token ORDER BY line, side) AS n, category, line_type, 'cut' AS start_type, 'cut' AS end_type, t AS points FROM tn
  WHERE {_edge('t[1]', max(VIEW.border, 6.0))} QUALIFY n <= {VIEW.max_lines}
)"""
_SHAPE = "category, line_type, start_type, end_type, len(points)::INT AS n_points, round(points[1].x, 4) AS first_x, round(points[1].y, 4) AS first_y, round(points[len(points)].x, 4) AS last_x, round(points[len(points)].y, 4) AS last_y"
_RANKED = f"""both_kinds AS (SELECT *, false AS traced FROM projected UNION ALL SELECT *, true FROM traces
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY token, category, line_type, round_even(points[1].x, 0)::INT, round_even(points[1].y, 0)::INT, round_even(points[len(points)].x, 0)::INT, round_even(points[len(points)].y, 0)::INT
    ORDER BY traced, n) AS nth FROM both_kinds
), states AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY traced, n) AS rank FROM firsts WHERE NOT traced OR nth = 1 QUALIFY rank <= {VIEW.max_lines})"""


def _shape() -> list:
    a, b = F.get("points", F.lit(0)), F.element_at("points", -1)
    ends = [F.round(p[c], 4).alias(f"{name}_{c}") for name, p in (("first", a), ("last", b)) for c in "xy"]
    return ["category", "line_type", "start_type", "end_type", F.size("points").alias("n_points"), *ends]


def _seen(spark: SparkSession, d: str) -> ps.Seen:
    return ps.Seen(_patches(spark, d), _global(spark, d), VIEW)


@query(f"{_STATE} SELECT token, line FROM cand")
def near_patch(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).near()


@query(f"{_STATE}, {_PROJECTED} SELECT token, n::INT AS n, {_SHAPE} FROM projected")
def project_to_patch(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).projected().select("token", "n", *_shape())


@query(f"{_STATE}, {_TRACES} SELECT token, n::INT AS n, {_SHAPE} FROM traces")
def cut_traces(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).traces().select("token", "n", *_shape())


@query(f"{_STATE}, {_PROJECTED}, {_TRACES}, {_RANKED} SELECT token, rank::INT AS rank, traced, {_SHAPE} FROM states")
def state_dedup(spark: SparkSession, d: str) -> DataFrame:
    out, _ = ps.state_lines(_patches(spark, d), _global(spark, d), VIEW)
    return out.select("token", "rank", "traced", *_shape())


@query(f"""{_STATE}, {_PROJECTED}, {_TRACES}, {_RANKED} SELECT token, coalesce(a.n, 0) AS num_candidate_lines, coalesce(b.n, 0) AS num_projected_lines, coalesce(c.n, 0) AS num_endpoint_primitives, coalesce(s.n, 0) AS num_state_lines
FROM p LEFT JOIN (SELECT token, count(*) AS n FROM cand GROUP BY token) a USING (token) LEFT JOIN (SELECT token, count(*) AS n FROM projected GROUP BY token) b USING (token)
LEFT JOIN (SELECT token, count(*) AS n FROM traces GROUP BY token) c USING (token) LEFT JOIN (SELECT token, count(*) AS n FROM states GROUP BY token) s USING (token)""")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return ps.state_lines(_patches(spark, d), _global(spark, d), VIEW)[1]


#: Patches of the scan: serialized lines of a token, its centre on a grid, eight scenes; every seventh has no place.
SCAN = ps.View(size=224, metres=0.27, max_lines=12, border=4.0, overlap=24.0, endpoint=40.0, step=2.0, radius=40.0)


def scan_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from polyspark.plans.catalogue import _serialized

    lines = settled(_serialized(spark, d), "serialized").withColumn("k", F.substring("token", 7, 20).cast("long"))
    k = F.col("k")
    place = lambda c: F.when(k % 7 != 3, c)
    patches = lines.select("token", "k").distinct().select(
        "token", F.concat(F.lit("s"), k % 8).alias("scene"), k.alias("pos"), F.concat(F.lit("patch_"), k - 8).alias("prev"),
        place(F.floor(k / 8) % 6 * 20.0).alias("x"), place(F.floor(k / 48) * -20.0).alias("y"), F.lit(224).alias("image_width"), F.lit(224).alias("image_height"),
        F.lit(0).alias("x_min"), F.lit(0).alias("y_min"), F.lit(224).alias("x_max"), F.lit(224).alias("y_max"), F.lit("").alias("original_image"),
    )
    return patches, lines.drop("k")


@query()
def state_scan(spark: SparkSession, d: str) -> DataFrame:
    seen, _, _ = ps.state_scan(*scan_input(spark, d), SCAN)
    return seen.select("token", "rank", "traced", *_shape())


@query()
def map_versions(spark: SparkSession, d: str) -> DataFrame:
    return ps.merged(*scan_input(spark, d), SCAN).select("scene", "pos", "rank", "died", *_shape())


@query()
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    patches, lines = scan_input(spark, d)
    patches, lines = settled(patches, "patches"), settled(lines, "lines")
    return ps.scan_report(patches, lines, *ps.state_scan(patches, lines, SCAN))


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = fx.lines(spark, d).withColumn("rank", F.col("line_idx"))
    k = F.substring("token", 7, 20).cast("long")
    frames = lines.select("token").distinct().select("token", (k % 8).alias("scene"), k.alias("pos"), (k % 5 * 4.0).alias("x"), (k % 7 * 3.0).alias("y"), F.radians(k * 25 % 360).alias("yaw"))
    return frames, lines.select("token", "rank", "category", "line_type", "points")


_EGO = f"""WITH {fx.LINES}, w AS (
  SELECT token, token[7:]::BIGINT AS k, token[7:]::BIGINT % 8 AS scene, line_idx AS rank, category, line_type, points, radians(token[7:]::BIGINT * 25 % 360) AS a FROM lines
), world AS (SELECT scene, k AS pos, rank, category, line_type, list_transform(points, lambda p: {{'x': p.x * cos(a) - p.y * sin(a) + k % 5 * 4.0::DOUBLE, 'y': p.x * sin(a) + p.y * cos(a) + k % 7 * 3.0::DOUBLE}}) AS points FROM w
), known AS (
  SELECT *, [round_even(points[1].x, 0), round_even(points[1].y, 0)] AS f, [round_even(points[32].x, 0), round_even(points[32].y, 0)] AS l FROM world
  QUALIFY row_number() OVER (PARTITION BY scene, category, line_type, least(f, l), greatest(f, l) ORDER BY pos, rank) = 1
), frames AS (SELECT DISTINCT token, k, scene, a, k % 5 * 4.0::DOUBLE AS x, k % 7 * 3.0::DOUBLE AS y FROM w
), loc AS (
  SELECT f.token, n.pos, n.rank, category, line_type, list_filter(list_transform(points, lambda p: {{'x': (p.x - x) * cos(a) + (p.y - y) * sin(a), 'y': (p.y - y) * cos(a) - (p.x - x) * sin(a)}}), lambda p: abs(p.x) <= 10 AND abs(p.y) <= 10) AS q
  FROM frames f JOIN known n ON f.scene = n.scene AND n.pos < f.k
), px AS (SELECT *, list_transform(q, lambda p: {{'x': (p.x + 10) * (223 / 20), 'y': (10 - p.y) * (223 / 20)}}) AS points FROM loc WHERE len(q) >= 2
), shown AS (SELECT token, row_number() OVER (PARTITION BY token ORDER BY pos, rank) AS place, category, line_type, {{0}} FROM px QUALIFY place <= 12)"""
_TYPES = ", ".join(f"CASE WHEN points[{i}].x <= 4.48 OR points[{i}].y <= 4.48 OR points[{i}].x >= 218.52 OR points[{i}].y >= 218.52 THEN 'cut' ELSE '{k}' END AS {k}_type" for i, k in (("1", "start"), ("len(points)", "end")))


@query(f"{_EGO.replace('{0}', _TYPES + ', points')} SELECT token, place::INT AS rank, {_SHAPE} FROM shown")
def ego_scan(spark: SparkSession, d: str) -> DataFrame:
    seen, _ = ego.scan(*_frames(spark, d), 224, 12, 10.0)
    return seen.select("token", "rank", *_shape())
