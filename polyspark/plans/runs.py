"""Queries that compare runs, keep derived rows, and follow external orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspark.functions import text, tokens
from polyspark.operators import cache, comparison, metrics, readiness, snapshot
from polyspark.operators import lines as ops
from polyspark.operators.stages import shared_folder
from polyspark.plans import fixtures as fx
from polyspark.plans.catalogue import _FOLD, _FRAMES, _IDS, _NAMED, _SERIAL, VOCAB, _encoded
from polyspark.plans.registry import query

LEVELS = (10.0, 15.0, 20.0)


def _bundle(keep: str) -> str:
    """Means of a run whose predictions are those that ``keep`` lets through, in SQL."""
    fold = _FOLD.replace("LEVELS", ", ".join(f"({t}::DOUBLE)" for t in LEVELS)).replace("FROM lines WHERE vec_id % 2 = 1", f"FROM lines WHERE vec_id % 2 = 1 AND {keep}")
    near = "EXISTS (SELECT 1 FROM {0} b WHERE b.sample = a.sample AND b.line <> a.line AND sqrt((a.e.x - b.e.x) * (a.e.x - b.e.x) + (a.e.y - b.e.y) * (a.e.y - b.e.y)) <= 12)"
    side = lambda t, idx: f"{t}_ends AS (SELECT sample, {idx} AS line, unnest([points[1], points[32]]) AS e FROM {t})"
    cont = lambda t, c: f"{t}_cont AS (SELECT sample, avg(CASE WHEN {near.format(t + '_ends')} THEN 1 ELSE 0 END) AS {c} FROM {t}_ends a GROUP BY sample)"
    f1 = "CASE WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 2 * (tp / greatest(np, 1)) * (tp / greatest(ng, 1)) / greatest(tp / greatest(np, 1) + tp / greatest(ng, 1), 1e-6) END"
    return f"""{fold}, items AS (SELECT DISTINCT vec_id // 10 AS sample FROM lines), near1 AS (SELECT sample, pred_idx, min(cost) AS near FROM cost GROUP BY ALL
), mc AS (SELECT sample, avg(coalesce(near, 64.0::DOUBLE)) AS mc FROM pred LEFT JOIN near1 USING (sample, pred_idx) GROUP BY sample
), np AS (SELECT sample, count(*) AS np FROM pred GROUP BY sample), ng AS (SELECT sample, count(*) AS ng FROM gt GROUP BY sample
), {side('pred', 'pred_idx')}, {side('gt', 'gt_idx')}, {cont('pred', 'cp')}, {cont('gt', 'cg')}
, base AS (SELECT sample, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(mc, 64.0::DOUBLE) AS mc, coalesce(cp, 0) AS cp, coalesce(cg, 0) AS cg FROM items LEFT JOIN np USING (sample) LEFT JOIN ng USING (sample)
  LEFT JOIN mc USING (sample) LEFT JOIN pred_cont USING (sample) LEFT JOIN gt_cont USING (sample)
), hit AS (SELECT t, sample, sum(n) AS tp FROM (SELECT t, sample, category, max(len(used)) AS n FROM m GROUP BY ALL) GROUP BY ALL
) SELECT 'APC@' || t::INT || 'px' AS metric, avg({f1}) AS value FROM base CROSS JOIN (VALUES {', '.join(f"({t}::DOUBLE)" for t in LEVELS)}) l(t) LEFT JOIN hit USING (t, sample) GROUP BY t
UNION ALL SELECT 'mean_chamfer_px', avg(mc) FROM base UNION ALL SELECT 'continuity_pred', avg(cp) FROM base UNION ALL SELECT 'continuity_gt', avg(cg) FROM base
UNION ALL SELECT 'continuity_gap', avg(abs(cp - cg)) FROM base UNION ALL SELECT 'pred_num_lines', avg(np) FROM base UNION ALL SELECT 'gt_num_lines', avg(ng) FROM base"""


@query(f"SELECT metric, round(a.value, 6) AS one, round(b.value, 6) AS two FROM ({_bundle('true')}) a FULL JOIN ({_bundle('vec_id % 4 = 3')}) b USING (metric)")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = fx.sides(spark, d)
    items = fx.lines(spark, d).select(F.expr("vec_id DIV 10").alias("sample"))
    runs = {name: comparison.sample_metrics(items, p, gt, LEVELS) for name, p in (("one", pred), ("two", pred.filter("pred_idx % 4 = 3")))}
    return comparison.compare_runs(runs).select("metric", F.round("one", 6).alias("one"), F.round("two", 6).alias("two"))


@query(f"{_SERIAL} SELECT token, rank::INT AS rank, category, len(points)::INT AS n_points FROM ser")
def cached_lines(spark: SparkSession, d: str) -> DataFrame:
    """Serialized lines through the signed cache: half of the patches first, then all, of which the other half is computed."""
    lines = fx.lines(spark, d)
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    sign = cache.signature({"interval": 6.0, "max_points": 24, "max_lines": 48})
    compute = lambda keys: ops.serialize(lines.join(keys, "token", "left_semi"))
    cache.read_through(lines.filter("vec_id % 20 < 10").select("token"), compute, path, sign)
    out = cache.read_through(lines.select("token"), compute, path, sign)
    return out.select("token", "rank", "category", F.size("points").alias("n_points"))


@query("""WITH o AS (SELECT doc_id, min(-quality * 1000000 - doc_id) AS pos FROM labels WHERE doc_id % 3 = 0 GROUP BY doc_id)
SELECT doc_id, row_number() OVER (ORDER BY coalesce(pos, 1000000000), doc_id NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN o USING (doc_id) QUALIFY place < 150""")
def split_order(spark: SparkSession, d: str) -> DataFrame:
    order = fx.table(spark, d, "labels").filter("doc_id % 3 = 0").select("doc_id", (-F.col("quality") * 1000000 - F.col("doc_id")).alias("pos"))
    rows = fx.table(spark, d, "documents").select("doc_id").distinct()
    return snapshot.in_order(rows, order, "doc_id", 150)


_STATUS = "WITH e AS (SELECT source AS split, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id, doc_id % 7 <> 0 AS image, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 4 END AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)"
_FIVE = "array_to_string(list_slice(list_sort(list(doc_id::VARCHAR) FILTER (WHERE {0} AND pos < 40)), 1, 5), ',')"


@query(f"""{_STATUS} SELECT split, count(*) AS total, count(*) FILTER (WHERE pos < 40) AS scanned, count(*) FILTER (WHERE pos < 40 AND image) AS image_exists, count(*) FILTER (WHERE pos < 40 AND n IS NOT NULL) AS annotation_exists,
  count(*) FILTER (WHERE pos < 40 AND n > 0) AS annotation_nonempty, coalesce({_FIVE.format('NOT image')}, '') AS missing_image, coalesce({_FIVE.format('n IS NULL')}, '') AS missing_annotation, coalesce({_FIVE.format('n = 0')}, '') AS empty_annotation FROM e GROUP BY split""")
def readiness_counters(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").filter("doc_id IS NOT NULL AND source IS NOT NULL")
    token = F.col("doc_id").cast("string").alias("token")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    expected = docs.select(F.col("source").alias("split"), pos.alias("pos"), token)
    annotations = docs.filter("doc_id % 5 <> 0").select(token, (F.col("n_chars") % 4).alias("num_lines"))
    out = readiness.readiness(expected, docs.filter("doc_id % 7 <> 0").select(token), annotations, 40)
    shown = [F.array_join(c, ",").alias(c) for c in ("missing_image", "missing_annotation", "empty_annotation")]
    return out.select("split", "total", "scanned", "image_exists", "annotation_exists", "annotation_nonempty", *shown)


@query("""SELECT o_orderkey, o_orderkey % 7 + (o_custkey / 4) + 2.5::DOUBLE AS total, 2 AS pairs, (o_orderkey % 100 - 50 + 3)::BIGINT AS sum_x FROM orders""")
def parsed_lists(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    numbers = text.float_list(F.concat(F.col("o_orderkey") % 7, F.lit(", "), F.col("o_custkey") / 4, F.lit(",,2.5")))
    pairs = text.offset_pairs(F.concat(F.col("o_orderkey") % 100 - 50, F.lit(",7; 3,-4;")))
    total = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)
    sum_x = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["x"])
    return o.select("o_orderkey", total.alias("total"), F.size(pairs).alias("pairs"), sum_x.alias("sum_x"))


@query(f"""WITH {_FRAMES}, c AS (SELECT f.token, a.token AS h1, b.token AS h2 FROM frames f LEFT JOIN frames a ON f.prev = a.token LEFT JOIN frames b ON a.prev = b.token)
SELECT token, array_to_string(list_concat(CASE WHEN h1 IS NULL THEN ['', ''] WHEN h2 IS NULL THEN [''] ELSE [] END, list_filter([h2::VARCHAR, h1::VARCHAR, token::VARCHAR], lambda x: x IS NOT NULL)), '>') AS frames FROM c""")
def temporal_window(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    frames = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("token"), F.lag("o_orderkey").over(by).cast("string").alias("prev"))
    return snapshot.window_of(frames, 3).select(F.col("token").cast("long").alias("token"), F.array_join("window", ">").alias("frames"))


_MASK_PIXELS = f"""WITH {fx.LINES}, src AS (
  SELECT vec_id // 10 AS image, vec_id % 2 AS side, CASE vec_id // 10 % 3 WHEN 0 THEN 96 WHEN 1 THEN 300 ELSE 64 END AS w, points FROM lines WHERE category <> 'Curb'
), px AS (
  SELECT image, side, greatest(1, round_even(4.0::DOUBLE * 64 / w, 0)) AS stroke, list_transform(points, lambda p: {{'x': (p.x + 30) * (63.0::DOUBLE / (w - 1)), 'y': (30 - p.y) * (63.0::DOUBLE / (w - 1))}}) AS points FROM src
), sg AS (SELECT image, side, stroke, points[i] AS p, points[i + 1] AS q FROM px, range(1, 32) t(i)), hit AS (
  SELECT DISTINCT image, side, y * 64 + x AS px FROM sg, range(0, 64) a(x), range(0, 64) b(y)
  WHERE x BETWEEN least(p.x, q.x) - stroke / 2 AND greatest(p.x, q.x) + stroke / 2 AND y BETWEEN least(p.y, q.y) - stroke / 2 AND greatest(p.y, q.y) + stroke / 2
    AND (p.x + greatest(0, least(1, ((x - p.x) * (q.x - p.x) + (y - p.y) * (q.y - p.y)) / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2))) * (q.x - p.x) - x) ** 2
      + (p.y + greatest(0, least(1, ((x - p.x) * (q.x - p.x) + (y - p.y) * (q.y - p.y)) / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2))) * (q.y - p.y) - y) ** 2 <= stroke * stroke / 4
)"""


@query(f"""{_MASK_PIXELS}, b AS (SELECT image, px, bool_or(side = 1) AS p, bool_or(side = 0) AS t FROM hit GROUP BY ALL)
SELECT image, round((count(*) FILTER (WHERE p AND t) + 1e-6) / (count(*) + 1e-6), 6) AS iou, round((2 * count(*) FILTER (WHERE p AND t) + 1e-6) / (count(*) FILTER (WHERE p) + count(*) FILTER (WHERE t) + 1e-6), 6) AS f1,
  count(*) FILTER (WHERE p) AS positive FROM b GROUP BY image""")
def lane_masks(spark: SparkSession, d: str) -> DataFrame:
    image = F.expr("vec_id DIV 10")
    width = F.when(image % 3 == 0, 96).when(image % 3 == 1, 300).otherwise(F.lit(None))
    points = F.transform("points", lambda p: F.struct((p["x"] + 30).alias("x"), (30 - p["y"]).alias("y")))
    rows = fx.lines(spark, d).select("vec_id", image.alias("image"), "category", points.alias("points"), width.alias("image_width"), width.alias("image_height"))
    side = lambda k: metrics.lane_masks(rows.filter(F.col("vec_id") % 2 == k), 64, 4.0, ("lane_line", "virtual_line"))
    out = metrics.mask_scores(side(1), side(0))
    return out.select("image", F.round("iou", 6).alias("iou"), F.round("f1", 6).alias("f1"), "positive")


@query(f"""{_IDS}, named AS ({_NAMED}), base AS (SELECT n_name AS token, n_nationkey::INT AS id FROM nation UNION ALL SELECT '<x_' || r_regionkey || '>', 25 + r_regionkey::INT FROM region
), size AS (SELECT max(id) + 1 AS n FROM base), places AS (SELECT v.id, coalesce(b.id, n + row_number() OVER (PARTITION BY b.id IS NULL ORDER BY v.id) - 1)::INT AS base_id FROM named v LEFT JOIN base b USING (token), size
), u AS (SELECT token, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM ids)
SELECT u.token, array_to_string(list(p.base_id ORDER BY k), ' ') AS ids, true AS back FROM u JOIN places p USING (id) GROUP BY u.token""")
def extended_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Coded patches as ids of a vocabulary of names that is extended by the map's tokens, and whether they come back."""
    x = F.concat(F.lit("<x_"), F.col("r_regionkey"), F.lit(">"))
    base = fx.table(spark, d, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").cast("int").alias("id"))
    base = base.unionByName(fx.table(spark, d, "region").select(x.alias("token"), (F.col("r_regionkey") + 25).cast("int").alias("id")))
    places = tokens.extended(base, VOCAB)
    there = tokens.remap(_encoded(spark, d), places).withColumns({"own": F.col("ids"), "ids": F.concat(F.array(F.lit(3)), "ids")})
    back = tokens.remap(there, places, back=True).withColumnRenamed("ids", "again")
    rows = tokens.remap(back, places, "again")
    return rows.select("token", F.array_join(F.transform("own", lambda i: i.cast("string")), " ").alias("ids"), (F.col("again") == F.col("own")).alias("back"))


@query("""SELECT event_id, CASE WHEN event_id % 200 < 20 THEN round(0.1 * (event_id % 200 + 1) / 20, 9) ELSE round(0.05 * (1 + cos(pi() * least(1, (event_id % 200 - 20) / 130))), 9) END AS rate,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE './data/' END || 'cam/' || event_id AS path FROM events""")
def schedule_and_paths(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    raw = F.concat(F.when(F.col("event_id") % 3 == 0, "./data/nuscenes/cam/").otherwise("./data/cam/"), F.col("event_id"))
    rate = text.cosine_rate(F.col("event_id") % 200, 150, 0.1, 20)
    return e.select("event_id", F.round(rate, 9).alias("rate"), text.relative_path(raw).alias("path"))
