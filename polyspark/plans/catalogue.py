"""All registered queries of the library and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.functions import text, tokens
from polyspark.operators import lines as ops
from polyspark.operators import metrics, snapshot, state, training
from polyspark.plans import fixtures as fx
from polyspark.plans import registry
from polyspark.plans.registry import SQL as _SQL
from polyspark.plans.registry import query as _query

VOCAB = tokens.Vocabulary()
SIZE = 224


#: Modules with further queries.
MODULES = ("evaluation", "states", "builder", "samples", "runs")


def _all() -> None:
    for name in MODULES:
        import_module(f"polyspark.plans.{name}")


def queries() -> dict:
    _all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(registry.SQL)


def _r(c, digits: int = 6):
    return F.round(c, digits)


_NORM = """norm AS (
  SELECT *, replace(lower(trim(category)), ' ', '_') AS cat, trim(regexp_replace(lower(trim(coalesce(line_type, ''))), '[-/_ ]+', ' ', 'g')) AS t0 FROM {0}
), typed AS (
  SELECT *, CASE WHEN t0 IN ('', 'none') THEN '' WHEN t0 IN ('solid', 'thick solid', 'dashed', 'short dashed', 'others') THEN replace(t0, ' ', '_') ELSE 'others' END AS lt FROM norm
)"""
_SAMPLED = f"""{fx.CUM}, sized AS (
  SELECT *, c[len(c)] AS total, least(greatest(floor(c[len(c)] / 6.0::DOUBLE) + 1, 2), 24)::INT AS n FROM cum
), sampled AS (
  SELECT * EXCLUDE (points), CASE WHEN total < 1e-6 THEN points[1:1] ELSE
    list_transform(list_transform(list_transform(range(0, n), lambda i: CASE WHEN i = n - 1 THEN total ELSE i * (total / (n - 1)) END),
      lambda t: {{'t': t, 'k': greatest(1, least(len(list_filter(c, lambda v: v <= t)), len(c) - 1))}}),
      lambda z: {{'x': points[z.k].x + (CASE WHEN c[z.k + 1] - c[z.k] > 0 THEN (z.t - c[z.k]) / (c[z.k + 1] - c[z.k]) ELSE 0 END) * (points[z.k + 1].x - points[z.k].x),
                  'y': points[z.k].y + (CASE WHEN c[z.k + 1] - c[z.k] > 0 THEN (z.t - c[z.k]) / (c[z.k + 1] - c[z.k]) ELSE 0 END) * (points[z.k + 1].y - points[z.k].y)}}) END AS points
  FROM sized
)"""
_K = (SIZE - 1) / 60.0
_BORDER = "({0}.x <= 4.48 OR {0}.y <= 4.48 OR {0}.x >= 218.52 OR {0}.y >= 218.52)"
_SERIAL = f"""WITH {fx.LINES}, {_SAMPLED}, px AS (
  SELECT * EXCLUDE (points), list_transform(points, lambda p: {{'x': (p.x + 30.0::DOUBLE) * {_K!r}::DOUBLE, 'y': (30.0::DOUBLE - p.y) * {_K!r}::DOUBLE}}) AS points FROM sampled
), {_NORM.format('px')}, ser AS (
  SELECT token, row_number() OVER (PARTITION BY token ORDER BY sqrt(points[1].x ** 2 + points[1].y ** 2), line_idx) AS rank, cat AS category, lt AS line_type,
         CASE WHEN {_BORDER.format('points[1]')} THEN 'cut' ELSE 'start' END AS start_type, CASE WHEN {_BORDER.format('points[len(points)]')} THEN 'cut' ELSE 'end' END AS end_type, points
  FROM typed QUALIFY rank <= 48
)"""


def _serialized(spark: SparkSession, d: str) -> DataFrame:
    return ops.serialize(fx.lines(spark, d))


def _first_last(p: str = "points") -> list:
    a, b = F.get(p, F.lit(0)), F.element_at(p, -1)
    return [_r(a["x"]).alias("first_x"), _r(a["y"]).alias("first_y"), _r(b["x"]).alias("last_x"), _r(b["y"]).alias("last_y")]


_FL = "round(points[1].x, 6) AS first_x, round(points[1].y, 6) AS first_y, round(points[len(points)].x, 6) AS last_x, round(points[len(points)].y, 6) AS last_y"


@_query(f"{_SERIAL} SELECT token, rank::INT AS rank, category, line_type, start_type, end_type, len(points)::INT AS n_points, {_FL} FROM ser")
def serialize_lines(spark: SparkSession, d: str) -> DataFrame:
    return _serialized(spark, d).select("token", "rank", "category", "line_type", "start_type", "end_type", F.size("points").alias("n_points"), *_first_last())


_PIXEL_LINES = f"""WITH {fx.LINES}, source AS (
  SELECT * REPLACE (list_transform(points, lambda p: {{'x': (p.x + 30.0::DOUBLE) * 10 * (223.0::DOUBLE / 599), 'y': (30.0::DOUBLE - p.y) * 10 * (223.0::DOUBLE / 599)}}) AS points) FROM lines
), {_SAMPLED.replace('FROM lines', 'FROM source').replace('6.0::DOUBLE', '40.0::DOUBLE')}, {_NORM.format('sampled')}, ser AS (
  SELECT token, row_number() OVER (PARTITION BY token ORDER BY sqrt(points[1].x ** 2 + points[1].y ** 2), line_idx) AS rank, cat AS category, lt AS line_type,
         CASE WHEN {_BORDER.format('points[1]')} THEN 'cut' ELSE 'start' END AS start_type, CASE WHEN {_BORDER.format('points[len(points)]')} THEN 'cut' ELSE 'end' END AS end_type, points
  FROM typed WHERE len(points) >= 2 QUALIFY rank <= 48
)"""


@_query(f"{_PIXEL_LINES} SELECT token, rank::INT AS rank, category, line_type, start_type, end_type, len(points)::INT AS n_points, {_FL} FROM ser")
def serialize_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Lines in pixels of a source image of 600, rescaled and then resampled every 40 pixels."""
    points = F.transform("points", lambda p: g.point((p["x"] + 30.0) * 10, (30.0 - p["y"]) * 10))
    rows = fx.lines(spark, d).withColumns({"points": points, "image_width": F.lit(600), "image_height": F.lit(600)})
    out = ops.serialize_pixels(rows, SIZE)
    return out.select("token", "rank", "category", "line_type", "start_type", "end_type", F.size("points").alias("n_points"), *_first_last())


@_query(f"WITH {fx.LINES}, {_NORM.format('lines')} SELECT vec_id, cat AS category, lt AS line_type, CASE WHEN lt IN ('solid', 'dashed', '') THEN lt ELSE '' END AS known FROM typed")
def normalize_vocab(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("line_type")
    return fx.lines(spark, d).select("vec_id", text.category(F.col("category")).alias("category"), text.line_type(t).alias("line_type"), text.known_line_type(t, ("solid", "dashed")).alias("known"))


@_query(f"WITH {fx.LINES}, {fx.CUM} SELECT vec_id, round(c[len(c)], 6) AS length FROM cum")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("vec_id", _r(g.length(F.col("points"))).alias("length"))


@_query(f"WITH {fx.LINES}, {fx.CUM} SELECT token, line_idx, round(c[len(c)], 6) AS length FROM cum QUALIFY row_number() OVER (PARTITION BY token ORDER BY c[len(c)] DESC, line_idx) = 1")
def longest_line(spark: SparkSession, d: str) -> DataFrame:
    return ops.longest(fx.lines(spark, d)).select("token", "line_idx", _r("length").alias("length"))


@_query(f"WITH {fx.LINES}, {_SAMPLED}, e AS (SELECT vec_id, unnest(points) AS p, unnest(range(0, len(points)))::INT AS pos FROM sampled) SELECT vec_id, pos, round(p.x, 5) AS x, round(p.y, 5) AS y FROM e")
def resample_points(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.lines(spark, d).select("vec_id", F.posexplode(g.resample(F.col("points"), 6.0, 24)).alias("pos", "p"))
    return rows.select("vec_id", "pos", _r("p.x", 5).alias("x"), _r("p.y", 5).alias("y"))


@_query(f"WITH {fx.LINES}, {fx.CUM} SELECT vec_id, (list_sum(list_transform(s, lambda x: greatest(ceil(x / 2.0::DOUBLE), 1))) + 1)::INT AS n FROM cum")
def densify_points(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("vec_id", F.size(g.densify(F.col("points"), 2.0)).alias("n"))


@_query(f"WITH {fx.LINES} SELECT vec_id, {_FL} FROM lines")
def world_pixel_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = g.pixel_to_world(g.world_to_pixel(F.col("points"), SIZE), SIZE)
    return fx.lines(spark, d).select("vec_id", F.inline(F.array(F.struct(back.alias("points"))))).select("vec_id", *_first_last())


@_query(f"{_SERIAL} SELECT start_type, end_type, count(*) AS n FROM ser GROUP BY ALL")
def border_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return _serialized(spark, d).groupBy("start_type", "end_type").agg(F.count("*").alias("n"))


@_query("""SELECT o_orderkey, round(cos(a) * dx + sin(a) * dy, 6) AS x, round(cos(a) * dy - sin(a) * dx, 6) AS y FROM (
  SELECT o_orderkey, radians(o_orderkey % 360) AS a, 10 - o_totalprice % 1000 AS dx, 20 - o_orderkey % 1000 AS dy FROM orders)""")
def ego_transform(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    half = F.radians(F.col("o_orderkey") % 360) / 2
    angle = g.yaw(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    points = F.array(g.point(F.lit(10.0), F.lit(20.0)))
    local = g.global_to_local(points, angle, F.col("o_totalprice") % 1000, F.col("o_orderkey") % 1000)
    return o.select("o_orderkey", F.get(local, F.lit(0)).alias("p")).select("o_orderkey", _r("p.x").alias("x"), _r("p.y").alias("y"))


@_query(f"""WITH {fx.PATCHES}, o AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM patches)
SELECT token, round(radians(lon - lon0) * {g.EARTH_RADIUS} * cos(radians(lat0)), 4) AS x, round(radians(lat - lat0) * {g.EARTH_RADIUS}, 4) AS y FROM patches, o""")
def equirect_projection(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.project_equirect(fx.patches(spark, d)).select("token", _r("x", 4).alias("x"), _r("y", 4).alias("y"))


@_query(f"""WITH {fx.PATCHES} SELECT token, scene, row_number() OVER w AS pos, coalesce(lag(token) OVER w, '') AS prev FROM patches
WINDOW w AS (PARTITION BY scene ORDER BY lat DESC, lon, token)""")
def scan_predecessor(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.patches(spark, d).withColumns({"x": F.col("lon"), "y": F.col("lat")})
    return snapshot.scan_order(rows, ["scene"]).select("token", "scene", F.col("pos").cast("long").alias("pos"), "prev")


_FRAMES = "frames AS (SELECT o_orderkey AS token, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)"


@_query(f"WITH {_FRAMES} SELECT f.token, f.prev AS h1, a.prev AS h2, b.prev AS h3 FROM frames f LEFT JOIN frames a ON f.prev = a.token LEFT JOIN frames b ON a.prev = b.token")
def temporal_chain(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    frames = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.lag("o_orderkey").over(by).alias("prev"))
    return snapshot.chain(frames, 3).select("token", "h1", "h2", "h3")


_TOKENS = "tok AS (SELECT 'log' || o_custkey || '__' || epoch(o_orderdate)::BIGINT || '__frame' || (o_orderkey % 1000) AS token, o_custkey, epoch(o_orderdate)::BIGINT AS stamp, o_orderkey % 1000 AS frame FROM orders)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    stamp = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.concat(F.lit("log"), "o_custkey", F.lit("__"), stamp, F.lit("__frame"), F.col("o_orderkey") % 1000).alias("token"))


@_query(f"WITH {_TOKENS} SELECT token, 'log' || o_custkey AS log, stamp, frame::BIGINT AS frame FROM tok")
def token_sort(spark: SparkSession, d: str) -> DataFrame:
    log, stamp, frame, token = snapshot.token_key()
    return _tokens(spark, d).select(log, stamp, frame, token)


@_query(f"""WITH {_TOKENS}, n AS (SELECT *, 'log' || o_custkey AS log, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY stamp, frame, token) AS i FROM tok)
SELECT log, CASE WHEN i > n - least(greatest(round_even(n * 0.2::DOUBLE, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS split, count(*) AS rows FROM n GROUP BY ALL""")
def tail_split(spark: SparkSession, d: str) -> DataFrame:
    log, stamp, frame, token = snapshot.token_key()
    rows = _tokens(spark, d).select(log, stamp, frame, token)
    return snapshot.tail_split(rows, ["log"], ["stamp", "frame", "token"], 0.2).groupBy("log", "split").agg(F.count("*").alias("rows"))


@_query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS status
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL) l ON d.doc_id = l.doc_id""")
def match_tokens_full(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.match_tokens(fx.table(spark, d, "documents"), fx.table(spark, d, "labels"), "doc_id")


@_query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE length(coalesce(text, '')) > 0) AS non_empty, count(*) FILTER (WHERE has) AS labelled, min(doc_id) FILTER (WHERE NOT has) AS first_missing
FROM (SELECT *, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL), false) AS has FROM documents) GROUP BY source""")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.audit(fx.table(spark, d, "documents"), fx.table(spark, d, "labels"), "doc_id", "text", "source")


AUG = [("rot090", 0, 0, 90.0), ("rot180", 0, 0, 180.0), ("rot270", 0, 0, 270.0), *((f"ovp_x{dx:+d}_y{dy:+d}", dx, dy, 0.0) for dx in (-448, 0, 448) for dy in (-448, 0, 448) if dx or dy), ("inc_-15", 0, 0, -15.0), ("inc_15", 0, 0, 15.0)]
_AUGMENTED = f"""WITH {fx.PATCHES}, spec(name, dx, dy, angle) AS (VALUES {', '.join(f"('{a}', {b}, {c}, {e}::DOUBLE)" for a, b, c, e in AUG)}), aug AS (
  SELECT p.token || '__' || name AS token, p.token AS parent, name, x_min + dx AS x_min, y_min + dy AS y_min, angle,
         x_min + dx >= 0 AND y_min + dy >= 0 AND x_min + dx + 896 <= 4096 AND y_min + dy + 896 <= 4096 AS inside FROM patches p, spec)"""


def _augmented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return snapshot.augment(fx.patches(spark, d), spark.createDataFrame(AUG, "name string, dx int, dy int, angle double"), 4096, 4096)


@_query(f"{_AUGMENTED} SELECT token, parent, name, x_min::BIGINT AS x_min, y_min::BIGINT AS y_min, angle FROM aug WHERE inside")
def aug_expand(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d)[0]


@_query(f"{_AUGMENTED} SELECT name, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS skipped FROM aug GROUP BY name")
def aug_summary(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d)[1]


@_query(f"""WITH {fx.LINES}, t AS (SELECT vec_id, list_transform(points, lambda p: CASE vec_id % 4 WHEN 1 THEN {{'x': p.y, 'y': 223.0::DOUBLE - p.x}} WHEN 2 THEN {{'x': 223.0::DOUBLE - p.x, 'y': 223.0::DOUBLE - p.y}}
  WHEN 3 THEN {{'x': 223.0::DOUBLE - p.y, 'y': p.x}} ELSE {{'x': p.x, 'y': p.y}} END) AS q FROM lines), points AS (
  SELECT vec_id, list_transform(q, lambda p: {{'x': CASE WHEN vec_id % 2 = 0 THEN 223.0::DOUBLE - p.x ELSE p.x END, 'y': CASE WHEN vec_id % 3 = 0 THEN 223.0::DOUBLE - p.y ELSE p.y END}}) AS points FROM t)
SELECT vec_id, {_FL} FROM points""")
def rotate_flip_points(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    turned = g.flip(g.quarter_turns(F.col("points"), v % 4, SIZE), v % 2 == 0, v % 3 == 0, SIZE)
    return fx.lines(spark, d).select("vec_id", F.inline(F.array(F.struct(turned.alias("points"))))).select("vec_id", *_first_last())


@_query(f"""WITH {fx.LINES}, r AS (SELECT vec_id, list_transform(points, lambda p: {{'x': cos(radians(15)) * p.x - sin(radians(15)) * p.y, 'y': sin(radians(15)) * p.x + cos(radians(15)) * p.y}}) AS q FROM lines)
SELECT vec_id, len(list_filter(q, lambda p: p.x BETWEEN -2 AND 42 AND p.y BETWEEN -2 AND 42))::INT AS n,
       round(coalesce(list_sum(list_transform(list_filter(q, lambda p: p.x BETWEEN -2 AND 42 AND p.y BETWEEN -2 AND 42), lambda p: least(40, greatest(0, p.x)))), 0), 5) AS sum_x FROM r""")
def crop_transform(spark: SparkSession, d: str) -> DataFrame:
    kept = g.inside_then_clamp(g.rotate(F.col("points"), F.lit(15.0), 0.0, 0.0), 40.0, 2.0)
    rows = fx.lines(spark, d).select("vec_id", F.inline(F.array(F.struct(kept.alias("points")))))
    return rows.select("vec_id", F.size("points").alias("n"), _r(F.aggregate("points", F.lit(0.0), lambda s, p: s + p["x"]), 5).alias("sum_x"))


@_query(f"""WITH {fx.PATCHES}, c AS (SELECT DISTINCT tile, round(lon, 4) AS lon FROM patches), s AS (SELECT *, lon - lag(lon) OVER (PARTITION BY tile ORDER BY lon) AS step FROM c)
SELECT tile, round(min(lon) - coalesce(median(step), 0) / 2, 6) AS low, round(max(lon) + coalesce(median(step), 0) / 2, 6) AS high, round(coalesce(median(step), 0), 6) AS step FROM s GROUP BY tile""")
def gps_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = fx.patches(spark, d).select("tile", F.format_string("{%.4f %.4f}", "lon", "lat").alias("c"))
    lon, _ = text.gps(F.col("c"))
    out = snapshot.axis_bounds(p.select("tile", lon.alias("lon")), ["tile"], "lon")
    return out.select("tile", _r("low").alias("low"), _r("high").alias("high"), _r("step").alias("step"))


@_query(f"""WITH {fx.LINES} SELECT vec_id, least(greatest(round_even((points[1].x + 30) * {_K!r}::DOUBLE, 0), 0), 223)::INT AS qx,
  least(greatest(round_even((30 - points[1].y) * {_K!r}::DOUBLE, 0), 0), 223)::INT AS qy FROM lines""")
def quantize_coords(spark: SparkSession, d: str) -> DataFrame:
    px = g.world_to_pixel(F.slice("points", 1, 1), SIZE)
    return fx.lines(spark, d).select("vec_id", F.get(px, F.lit(0)).alias("p")).select("vec_id", tokens.quantize(F.col("p.x"), VOCAB).alias("qx"), tokens.quantize(F.col("p.y"), VOCAB).alias("qy"))


@_query("SELECT event_id, round_even((((value * 7 - 360) % 360) + 360) % 360 * 359 / 360, 0)::INT AS angle FROM events")
def quantize_angles(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select("event_id", tokens.quantize_angle(F.col("value") * 7 - 360, VOCAB).alias("angle"))


_IDS = f"""{_SERIAL}, coded AS (
  SELECT token, rank, [7, 9 + list_position({list(text.CATEGORIES)}, category)] || (CASE WHEN line_type = '' THEN [] ELSE [12 + list_position({list(text.LINE_TYPES)}, line_type)] END)
         || [CASE start_type WHEN 'cut' THEN 19 ELSE 18 END, CASE end_type WHEN 'cut' THEN 21 ELSE 20 END, 8]
         || flatten(list_transform(points, lambda p: [22 + least(greatest(round_even(p.x, 0), 0), 223)::INT, 246 + least(greatest(round_even(p.y, 0), 0), 223)::INT])) || [9] AS ids FROM ser
), ids AS (SELECT token, list_slice([1] || flatten(list(ids ORDER BY rank)), 1, 255) || [2] AS ids FROM coded GROUP BY token)"""


def _encoded(spark: SparkSession, d: str, max_len: int = 256) -> DataFrame:
    one = F.struct("rank", "category", "line_type", "start_type", "end_type", "points")
    per = _serialized(spark, d).groupBy("token").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    return per.select("token", tokens.encode(F.col("lines"), VOCAB, max_len).alias("ids"))


@_query(f"{_IDS} SELECT token, len(ids)::INT AS n, array_to_string(ids, ' ') AS ids FROM ids")
def encode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("token", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@_query(f"""{_IDS}, whole AS (SELECT c.token, c.rank, sum(len(c.ids)) OVER (PARTITION BY c.token ORDER BY c.rank) + 1 AS upto FROM coded c)
SELECT s.token, (s.rank - 1)::INT AS line_no, s.category, s.line_type, s.start_type, s.end_type, len(s.points)::INT AS n_points,
       least(greatest(round_even(s.points[1].x, 0), 0), 223)::INT::DOUBLE AS first_x, least(greatest(round_even(s.points[1].y, 0), 0), 223)::INT::DOUBLE AS first_y
FROM ser s JOIN whole w ON s.token = w.token AND s.rank = w.rank WHERE w.upto <= 255""")
def decode_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = F.get("points", F.lit(0))
    out = tokens.decode(_encoded(spark, d), VOCAB)
    return out.select("token", "line_no", "category", "line_type", "start_type", "end_type", F.size("points").alias("n_points"), p["x"].alias("first_x"), p["y"].alias("first_y"))


@_query(f"""{_SERIAL} SELECT token, rank::INT AS rank, array_to_string([4, 22 + least(greatest(round_even(points[1].x, 0), 0), 223)::INT, 246 + least(greatest(round_even(points[1].y, 0), 0), 223)::INT,
  22 + least(greatest(round_even(points[len(points)].x, 0), 0), 223)::INT, 246 + least(greatest(round_even(points[len(points)].y, 0), 0), 223)::INT, 6], ' ') AS ids FROM ser""")
def target_prompt(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.target_prompt(F.get("points", F.lit(0)), F.element_at("points", -1), VOCAB)
    return _serialized(spark, d).select("token", "rank", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@_query(f"""{_SERIAL}, n AS (SELECT token, count(*) AS n, count(*) FILTER (WHERE start_type = 'cut' OR end_type = 'cut') AS c,
  count(*) FILTER (WHERE start_type = 'cut') + count(*) FILTER (WHERE end_type = 'cut') AS t FROM ser GROUP BY token)
SELECT token, least(n, 6)::INT AS every, least(CASE WHEN c > 0 THEN c ELSE least(n, 8) END, 6)::INT AS cut_only, least(CASE WHEN t > 0 THEN t ELSE least(n, 4) END, 6)::INT AS cut_traces FROM n""")
def state_prefix_modes(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("rank", "category", "line_type", "start_type", "end_type", "points")
    per = _serialized(spark, d).groupBy("token").agg(F.array_sort(F.collect_list(one)).alias("l"))
    lines = F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in ("category", "line_type", "start_type", "end_type", "points")]))
    count = lambda mode, name: F.size(tokens.state_prefix(lines, mode, 6)).alias(name)
    return per.select("token", count("all", "every"), count("cut_only", "cut_only"), count("cut_traces", "cut_traces"))


_NAMED = (
    "SELECT i::INT AS id, CASE WHEN i < 22 THEN [" + ", ".join(f"'{t}'" for t in VOCAB.named()) + f"][i + 1] WHEN i < {VOCAB.first_y} THEN '<x_' || (i - {VOCAB.first_x}) || '>' "
    f"WHEN i < {VOCAB.first_angle} THEN '<y_' || (i - {VOCAB.first_y}) || '>' ELSE '<a_' || (i - {VOCAB.first_angle}) || '>' END AS token FROM range({VOCAB.n}) t(i)"
)
_USED = f"{_IDS}, used AS (SELECT unnest(ids) AS id, token AS patch FROM ids), named AS ({_NAMED})"


def _used(spark: SparkSession, d: str) -> DataFrame:
    """``id, n``: how often each id occurs in the coded patches."""
    return _encoded(spark, d).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@_query(f"{_USED} SELECT id, named.token, count(patch) AS n FROM named LEFT JOIN used USING (id) GROUP BY ALL")
def vocab_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole vocabulary with the uses of each token."""
    return tokens.table(spark, VOCAB).join(_used(spark, d), "id", "left").select("id", "token", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@_query(f"""{_USED}, s AS (SELECT id, named.token, count(*) AS n, regexp_extract(named.token, '^<([a-z]+)_.*>$', 1) AS kind, replace(regexp_extract(named.token, '^<[a-z]+_(.*)>$', 1), '_', ' ') AS rest FROM named JOIN used USING (id) GROUP BY ALL)
SELECT id, token, n, CASE token WHEN '<bos>' THEN 'begin map' WHEN '<eos>' THEN 'end map' WHEN '<state>' THEN 'previous map state' WHEN '<txt_xy>' THEN 'xy coordinates' WHEN '<txt_trace>' THEN 'trace points'
  WHEN '<txt_end>' THEN 'end text' WHEN '<line>' THEN 'polyline' WHEN '<pts>' THEN 'points' WHEN '<eol>' THEN 'end of polyline'
  ELSE CASE kind WHEN 's' THEN 'start ' WHEN 'e' THEN 'end ' WHEN 'x' THEN 'x coordinate ' WHEN 'y' THEN 'y coordinate ' WHEN 'a' THEN 'angle ' ELSE '' END || rest END AS phrase FROM s""")
def semantic_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The phrase of every token that a patch uses."""
    rows = _used(spark, d).join(tokens.table(spark, VOCAB), "id")
    return rows.select("id", "token", "n", text.phrase(F.col("token")).alias("phrase"))


_COST = f"""WITH {fx.SIDES}, pairs AS (SELECT p.sample, p.category, pred_idx, gt_idx, p.points AS p, g.points AS q FROM pred p JOIN gt g USING (sample, category)), cost AS (
  SELECT sample, category, pred_idx, gt_idx,
    (list_sum(list_transform(p, lambda a: list_min(list_transform(q, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))) / len(p)
     + list_sum(list_transform(q, lambda a: list_min(list_transform(p, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))) / len(q)) / 2 AS cost FROM pairs)"""


@_query(f"{_COST} SELECT sample, category, pred_idx, gt_idx, round(cost, 6) AS cost FROM cost")
def chamfer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_costs(*fx.sides(spark, d)).withColumn("cost", _r("cost"))


@_query(f"""{_COST}, near AS (SELECT sample, pred_idx, min(cost) AS near FROM cost GROUP BY ALL)
SELECT sample, round(avg(coalesce(near, 64.0::DOUBLE)), 6) AS mean_chamfer FROM pred LEFT JOIN near USING (sample, pred_idx) GROUP BY sample""")
def mean_chamfer(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_chamfer(*fx.sides(spark, d)).withColumn("mean_chamfer", _r("mean_chamfer"))


#: The fold at several thresholds: what is used grows prediction by prediction.
_FOLD = f"""{_COST.replace('WITH ', 'WITH RECURSIVE ', 1)}, near AS (
  SELECT sample, category, row_number() OVER (PARTITION BY sample, category ORDER BY pred_idx) AS k, list({{'cost': cost, 'gt': gt_idx}} ORDER BY cost, gt_idx) AS near FROM cost GROUP BY sample, category, pred_idx
), m AS (
  SELECT t, sample, category, 0::BIGINT AS k, []::BIGINT[] AS used FROM near, (VALUES LEVELS) l(t) WHERE k = 1
  UNION ALL
  SELECT t, m.sample, m.category, n.k, CASE WHEN len(list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))) > 0 AND list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))[1].cost <= t
    THEN list_append(m.used, list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))[1].gt) ELSE m.used END
  FROM m JOIN near n ON m.sample = n.sample AND m.category = n.category AND n.k = m.k + 1
)"""


@_query(f"""{_COST.replace('WITH ', 'WITH RECURSIVE ', 1)}, near AS (
  SELECT sample, category, pred_idx, row_number() OVER (PARTITION BY sample, category ORDER BY pred_idx) AS k, list({{'cost': cost, 'gt': gt_idx}} ORDER BY cost, gt_idx) AS near FROM cost GROUP BY sample, category, pred_idx
), m AS (
  SELECT sample, category, 0::BIGINT AS k, []::BIGINT[] AS used FROM near WHERE k = 1
  UNION ALL
  SELECT m.sample, m.category, n.k, CASE WHEN len(list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))) > 0 AND list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))[1].cost <= t.t
    THEN list_append(m.used, list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))[1].gt) ELSE m.used END
  FROM m JOIN near n ON m.sample = n.sample AND m.category = n.category AND n.k = m.k + 1, (SELECT 15.0::DOUBLE AS t) t
) SELECT sample, category, max(len(used))::BIGINT AS matched FROM m GROUP BY ALL HAVING max(len(used)) > 0""")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    costs = metrics.pair_costs(*fx.sides(spark, d)).withColumn("ord", F.col("pred_idx"))
    return metrics.greedy_match(costs, "ord", 15.0).groupBy("sample", "category").agg(F.count("*").alias("matched"))


@_query(f"""{_FOLD.replace("LEVELS", "(10.0::DOUBLE), (15.0::DOUBLE), (20.0::DOUBLE)")}, n AS (SELECT (SELECT count(*) FROM pred) AS p, (SELECT count(*) FROM gt) AS g),
hit AS (SELECT t AS threshold, coalesce(sum(n), 0)::BIGINT AS tp FROM (VALUES (10.0::DOUBLE), (15.0::DOUBLE), (20.0::DOUBLE)) l(t) LEFT JOIN (SELECT t, sample, category, max(len(used)) AS n FROM m GROUP BY ALL) USING (t) GROUP BY t)
SELECT threshold, tp, p - tp AS fp, g - tp AS fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / g) / (tp / p + tp / g) END, 6) AS f1 FROM hit, n""")
def f1_at_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.f1_at(*fx.sides(spark, d), [10.0, 15.0, 20.0]).withColumn("f1", _r("f1"))


_RANKED = "ranked AS (SELECT event_type, event_id, value, event_id % 3 = 0 AS tp FROM events), truth AS (SELECT event_type, count(*) FILTER (WHERE tp) + 5 AS num_gt FROM ranked GROUP BY event_type)"
_AP = f"""WITH {_RANKED}, r AS (SELECT event_type, row_number() OVER w AS k, sum(tp::INT) OVER w AS c FROM ranked WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)),
pr AS (SELECT event_type, k, c / num_gt AS rec, c / k AS pre FROM r JOIN truth USING (event_type)),
env AS (SELECT event_type, k, rec, max(pre) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM pr),
ap AS (SELECT event_type, sum(gain) AS ap FROM (SELECT event_type, (rec - lag(rec, 1, 0) OVER (PARTITION BY event_type ORDER BY k)) * e AS gain FROM env) GROUP BY event_type)"""


def _ap(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select("event_type", "event_id", "value", (F.col("event_id") % 3 == 0).alias("tp"))
    truth = e.groupBy("event_type").agg((F.count_if("tp") + 5).alias("num_gt"))
    return metrics.average_precision(e, truth, ["event_type"], [F.desc("value"), "event_id"])


@_query(f"{_AP} SELECT event_type, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _ap(spark, d).withColumn("ap", _r("ap"))


@_query(f"{_AP} SELECT round(avg(ap), 6) AS mean_ap FROM ap")
def apm_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _ap(spark, d).agg(_r(F.avg("ap")).alias("mean_ap"))


_PIXELS = f"""WITH {fx.SIDES}, sided AS (SELECT 'p' AS side, sample, pred_idx AS id, category, points FROM pred UNION ALL SELECT 'g', sample, gt_idx, category, points FROM gt), px AS (
  SELECT side, sample, id, category, list_transform(points, lambda p: {{'x': (p.x + 30) * 1.05::DOUBLE, 'y': (30 - p.y) * 1.05::DOUBLE}}) AS points FROM sided
), sg AS (SELECT side, sample, id, category, points[i] AS p, points[i + 1] AS q FROM px, range(1, 32) t(i)), hit AS (
  SELECT DISTINCT side, sample, id, category, y * 64 + x AS px FROM sg, range(0, 64) a(x), range(0, 64) b(y)
  WHERE x BETWEEN least(p.x, q.x) - 1.5 AND greatest(p.x, q.x) + 1.5 AND y BETWEEN least(p.y, q.y) - 1.5 AND greatest(p.y, q.y) + 1.5
    AND (p.x + greatest(0, least(1, ((x - p.x) * (q.x - p.x) + (y - p.y) * (q.y - p.y)) / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2))) * (q.x - p.x) - x) ** 2
      + (p.y + greatest(0, least(1, ((x - p.x) * (q.x - p.x) + (y - p.y) * (q.y - p.y)) / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2))) * (q.y - p.y) - y) ** 2 <= 2.25
)"""


def _pixel_sides(spark: SparkSession, d: str) -> list[DataFrame]:
    return [x.withColumn("points", g.world_to_pixel(F.col("points"), 64)) for x in fx.sides(spark, d)]


@_query(f"""{_PIXELS}, c AS (SELECT sample, category, px, bool_or(side = 'p') AND bool_or(side = 'g') AS i FROM hit GROUP BY ALL)
SELECT category, round(count(*) FILTER (WHERE i) / count(*), 6) AS iou FROM c GROUP BY category""")
def semantic_miou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.semantic_miou(*_pixel_sides(spark, d), 3.0, 64).withColumn("iou", _r("iou"))


@_query(f"""{_PIXELS}, n AS (SELECT side, sample, id, count(*) AS n FROM hit GROUP BY ALL), c AS (
  SELECT a.sample, a.category, a.id AS pred_idx, b.id AS gt_idx, count(*) AS n FROM hit a JOIN hit b ON a.side = 'p' AND b.side = 'g' AND a.sample = b.sample AND a.category = b.category AND a.px = b.px GROUP BY ALL)
SELECT c.sample, c.category, pred_idx, gt_idx, round(c.n / (p.n + g.n - c.n), 6) AS iou FROM c JOIN n p ON p.side = 'p' AND p.id = pred_idx JOIN n g ON g.side = 'g' AND g.id = gt_idx""")
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mask_iou(*_pixel_sides(spark, d), 3.0, 64).withColumn("iou", _r("iou"))


@_query("""SELECT l_suppkey, round((count(*) FILTER (WHERE h AND t) + 1e-6) / (count(*) FILTER (WHERE h OR t) + 1e-6), 6) AS iou,
  round((2 * count(*) FILTER (WHERE h AND t) + 1e-6) / (count(*) FILTER (WHERE h) + count(*) FILTER (WHERE t) + 1e-6), 6) AS f1, count(*) FILTER (WHERE h) AS positive, round(avg(p), 6) AS mean_prob
FROM (SELECT l_suppkey, l_discount * 10 AS p, l_discount * 10 >= 0.5::DOUBLE AS h, l_returnflag = 'R' AS t FROM lineitem) GROUP BY l_suppkey""")
def lane_mask_metrics(spark: SparkSession, d: str) -> DataFrame:
    px = fx.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("prob"), (F.col("l_returnflag") == "R").alias("target"))
    return metrics.mask_metrics(px, "l_suppkey", 0.5).select("l_suppkey", _r("iou").alias("iou"), _r("f1").alias("f1"), "positive", _r("mean_prob").alias("mean_prob"))


_ENDS = f"WITH {fx.LINES}, ends AS (SELECT vec_id // 10 AS sample, vec_id AS line, unnest([0, 1]) AS side, unnest([points[1], points[32]]) AS e FROM lines)"


@_query(f"""{_ENDS} SELECT sample, round(avg(CASE WHEN EXISTS (SELECT 1 FROM ends b WHERE b.sample = a.sample AND b.line <> a.line
  AND sqrt((a.e.x - b.e.x) * (a.e.x - b.e.x) + (a.e.y - b.e.y) * (a.e.y - b.e.y)) <= 12) THEN 1 ELSE 0 END), 6) AS score FROM ends a GROUP BY sample""")
def continuity_score(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.lines(spark, d).select(F.expr("vec_id DIV 10").alias("sample"), F.col("vec_id").alias("line"), "points")
    return metrics.continuity(rows, 12.0).withColumn("score", _r("score"))


@_query(f"""WITH {fx.LINES}, k AS (SELECT vec_id, [category, line_type] AS a, [round_even(points[1].x / 40, 0), round_even(points[1].y / 40, 0)] AS f, [round_even(points[32].x / 40, 0), round_even(points[32].y / 40, 0)] AS l FROM lines)
SELECT vec_id FROM k QUALIFY row_number() OVER (PARTITION BY a, least(f, l), greatest(f, l) ORDER BY vec_id) = 1""")
def signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedup_signature(fx.lines(spark, d), ["vec_id"], 40.0).select("vec_id")


@_query(f"""WITH {fx.LINES}, p AS (SELECT 'cust_' || c_custkey AS token, (c_custkey % 40 - 20) * 3.0::DOUBLE AS x, (c_custkey // 40 - 20) * 3.0::DOUBLE AS y FROM customer), v AS (SELECT vec_id AS line, unnest(points) AS p FROM lines)
SELECT DISTINCT token, line FROM p JOIN v ON sqrt((v.p.x - p.x) * (v.p.x - p.x) + (v.p.y - p.y) * (v.p.y - p.y)) <= 4.0""")
def adjacency_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    at = fx.table(spark, d, "customer").select(F.concat(F.lit("cust_"), k).alias("token"), ((k % 40 - 20) * 3.0).alias("x"), ((F.floor(k / 40) - 20) * 3.0).alias("y"))
    return state.adjacent(at, fx.lines(spark, d).withColumnRenamed("vec_id", "line"), 4.0)


@_query(f"""{_ENDS}, k AS (SELECT e.*, category, line_type FROM ends e JOIN lines l ON l.vec_id = e.line), c AS (
  SELECT n.line, b.line AS base, CASE WHEN b.side = 1 AND n.side = 0 THEN 0 WHEN b.side = 0 AND n.side = 1 THEN 1 WHEN b.side = 1 THEN 2 ELSE 3 END AS way,
         sqrt((b.e.x - n.e.x) * (b.e.x - n.e.x) + (b.e.y - n.e.y) * (b.e.y - n.e.y)) AS dist
  FROM k n JOIN k b ON n.category = b.category AND n.line_type = b.line_type AND n.line % 16 >= 8 AND b.line % 16 < 8)
SELECT line, base, way::INT AS way, round(dist, 6) AS dist FROM c WHERE dist <= 15 QUALIFY row_number() OVER (PARTITION BY line ORDER BY dist, base, way) = 1""")
def nearest_endpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.lines(spark, d).withColumnRenamed("vec_id", "line")
    return state.nearest_end(rows.filter("line % 16 >= 8"), rows.filter("line % 16 < 8"), 15.0).withColumn("dist", _r("dist"))


@_query()
def merge_global_lines(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("token", 7, 20).cast("long")
    rows = _serialized(spark, d).withColumns({"scene": F.concat(F.lit("s"), number % 8), "pos": number, "rank": F.col("rank")})
    return state.merge_maps(rows, 12.0).select("scene", "line_no", "category", "line_type", "start_type", "end_type", F.size("points").alias("n_points"))


@_query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_loss, round(count(*) FILTER (WHERE l_linestatus = 'O') / count(*), 6) AS token_accuracy FROM lineitem GROUP BY l_returnflag""")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    out = training.weighted_loss(fx.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", F.col("l_linestatus") == "O")
    return out.select("l_returnflag", _r("weighted_loss", 4).alias("weighted_loss"), _r("token_accuracy").alias("token_accuracy"))


@_query("""WITH h AS (SELECT event_id, md5('7:' || event_id::VARCHAR) AS m FROM events) SELECT event_id, m[1] >= '4' AS image, m[1] < '4' OR m[2] >= '4' AS text FROM h""")
def modality_mask(spark: SparkSession, d: str) -> DataFrame:
    """Each modality stays by a seeded hash of the row; where the first goes the second stays."""
    image, words = training.modality_mask(F.col("event_id"), 7, 0.25, 0.25)
    return fx.table(spark, d, "events").select("event_id", image.alias("image"), words.alias("text"))


@_query("""WITH h AS (SELECT event_id % 5 AS epoch, value, md5('7:' || event_id::VARCHAR) AS m FROM events)
SELECT epoch, count(*) AS steps, round(avg(value), 6) AS value, round(count(*) FILTER (WHERE m[1] < '4') / count(*), 6) AS image_dropped_ratio FROM h GROUP BY epoch""")
def epoch_report(spark: SparkSession, d: str) -> DataFrame:
    image, _ = training.modality_mask(F.col("event_id"), 7, 0.25, 0.25)
    rows = fx.table(spark, d, "events").select((F.col("event_id") % 5).alias("epoch"), "value", (~image).alias("image_dropped"))
    out = training.epoch_report(rows, "epoch", ["value"], ["image_dropped"])
    return out.select("epoch", "steps", _r("value").alias("value"), _r("image_dropped_ratio").alias("image_dropped_ratio"))


@_query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, n::INT AS n, (max(n) OVER (PARTITION BY conv_id) - n)::INT AS padding, greatest(n - 1, 0)::INT AS loss_tokens FROM c""")
def pad_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch is a conversation: its rows are padded to the longest, and the loss counts all but the first token."""
    c = fx.table(spark, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return c.select("conv_id", "turn", "n", (F.max("n").over(Window.partitionBy("conv_id")) - F.col("n")).alias("padding"), F.greatest(F.col("n") - 1, F.lit(0)).alias("loss_tokens"))
