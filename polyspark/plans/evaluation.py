"""Queries of the official evaluation, over lines of odd and even number as predictions and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.operators import evaluation as ev
from polyspark.plans import fixtures as fx
from polyspark.plans.catalogue import _PIXELS, _pixel_sides
from polyspark.plans.registry import query

#: Metres per unit of the lines, and the length of a cut: lines are 50 m long, so that SQL can take every distance.
METRES, STEP = 0.05, 0.5
CHAMFER = [0.5, 0.6, 0.75]
MASK = [0.05, 0.1, 0.15, 0.2, 0.3]
_CATEGORIES = ("Lane line", "Curb")


def _scored(pred: DataFrame) -> DataFrame:
    """Every tenth prediction comes without a score."""
    none = F.col("pred_idx") % 10 == 9
    return pred.withColumns({"score": F.when(none, 1.0).otherwise((F.col("pred_idx") * 37 % 101) / 100.0), "fallback": none})


_SCORE = "CASE WHEN pred_idx % 10 = 9 THEN 1.0 ELSE (pred_idx * 37 % 101) / 100 END"


@query(f"""WITH {fx.SIDES}, b AS (SELECT bool_or(pred_idx % 10 = 9) AS f, bool_or(pred_idx % 10 <> 9) AS e FROM pred WHERE category IN {_CATEGORIES})
SELECT CASE WHEN f AND e THEN 'mixed_explicit_and_constant_fallback' WHEN e THEN 'explicit_line_scores' ELSE 'constant_1.0_fallback' END AS score_mode FROM b""")
def score_mode(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_mode(_scored(fx.sides(spark, d)[0]), _CATEGORIES)


def _dense(side: str, idx: str) -> str:
    seg = f"sqrt((points[i + 1].x - points[i].x) ** 2 + (points[i + 1].y - points[i].y) ** 2) * {METRES}::DOUBLE"
    at = lambda c: f"{METRES}::DOUBLE * points[i].{c} + ({METRES}::DOUBLE * points[i + 1].{c} - {METRES}::DOUBLE * points[i].{c}) * k / greatest(ceil({seg} / {STEP}::DOUBLE), 1)"
    cut = f"list_transform(range(0, greatest(ceil({seg} / {STEP}::DOUBLE), 1)::BIGINT), lambda k: {{'x': {at('x')}, 'y': {at('y')}}})"
    last = f"{{'x': {METRES}::DOUBLE * points[32].x, 'y': {METRES}::DOUBLE * points[32].y}}"
    return f"SELECT sample, category, {idx}, flatten(list_transform(range(1, 32), lambda i: {cut})) || [{last}] AS q FROM {side}"


_ONE_WAY = "list_sum(list_transform({0}, lambda a: list_min(list_transform({1}, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))) / len({0})"
_CHAMFER = f"""cost AS (SELECT sample, category, pred_idx, gt_idx, ({_ONE_WAY.format('p.q', 'g.q')} + {_ONE_WAY.format('g.q', 'p.q')}) / 2 AS cost
  FROM ({_dense('pred', 'pred_idx')}) p JOIN ({_dense('gt', 'gt_idx')}) g USING (sample, category))"""
_MASK = """n AS (SELECT side, sample, id, count(*) AS n FROM hit GROUP BY ALL), c AS (
  SELECT a.sample, a.category, a.id AS pred_idx, b.id AS gt_idx, count(*) AS n FROM hit a JOIN hit b
  ON a.side = 'p' AND b.side = 'g' AND a.sample = b.sample AND a.category = b.category AND a.px = b.px GROUP BY ALL
), cost AS (SELECT c.sample, c.category, pred_idx, gt_idx, -(c.n / (p.n + g.n - c.n)) AS cost FROM c
  JOIN n p ON p.side = 'p' AND p.id = pred_idx JOIN n g ON g.side = 'g' AND g.id = gt_idx)"""


def _ap(head: str, cost: str, levels: list[float]) -> str:
    """The matching as a recursion over predictions by score, and AP from running counts."""
    free = "list_filter(n.near, lambda b: NOT list_contains(m.used, b.gt))"
    return f"""{head.replace('WITH ', 'WITH RECURSIVE ', 1)}, {cost}, level(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in levels)}
), scored AS (SELECT sample, category, pred_idx, {_SCORE} AS score FROM pred
), near AS (
  SELECT s.sample, s.category, s.pred_idx, s.score, row_number() OVER (PARTITION BY s.sample, s.category ORDER BY s.score DESC, s.pred_idx) AS k,
         list({{'cost': cost, 'gt': gt_idx}} ORDER BY cost, gt_idx) FILTER (WHERE gt_idx IS NOT NULL) AS near
  FROM scored s LEFT JOIN cost USING (sample, category, pred_idx) GROUP BY s.sample, s.category, s.pred_idx, s.score
), m AS (
  SELECT threshold, sample, category, 0::BIGINT AS k, []::BIGINT[] AS used, false AS tp FROM near, level WHERE k = 1
  UNION ALL
  SELECT threshold, m.sample, m.category, n.k, CASE WHEN {free}[1].cost <= threshold THEN list_append(m.used, {free}[1].gt) ELSE m.used END, coalesce({free}[1].cost <= threshold, false)
  FROM m JOIN near n ON m.sample = n.sample AND m.category = n.category AND n.k = m.k + 1
), r AS (
  SELECT threshold, n.category, n.score, n.sample, n.pred_idx, m.tp, row_number() OVER w AS k, sum(m.tp::INT) OVER w AS c FROM m JOIN near n USING (sample, category, k)
  WINDOW w AS (PARTITION BY threshold, n.category ORDER BY n.score DESC, n.sample, n.pred_idx)
), env AS (SELECT *, max(c / k) OVER (PARTITION BY threshold, category ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM r
), ap AS (
  SELECT t.category, l.threshold, coalesce(sum(e.e) / any_value(t.n), 0) AS ap FROM (SELECT category, count(*) AS n FROM gt GROUP BY category) t CROSS JOIN level l
  LEFT JOIN env e ON e.category = t.category AND e.threshold = l.threshold AND e.tp GROUP BY t.category, l.threshold
)"""


_BY_CHAMFER = _ap(f"WITH {fx.SIDES}", _CHAMFER, CHAMFER)
_BY_MASK = _ap(_PIXELS, _MASK, [-t for t in MASK])


def _by_chamfer(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = fx.sides(spark, d)
    return ev.official_ap(_scored(pred), gt, ev.chamfer_costs(pred, gt, METRES, STEP), CHAMFER)


def _by_mask(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = _pixel_sides(spark, d)
    aps = ev.official_ap(_scored(pred), gt, ev.mask_costs(pred, gt, 3.0, 64), [-t for t in MASK])
    return aps.withColumn("threshold", -F.col("threshold"))


@query(f"{_BY_CHAMFER} SELECT category, threshold, round(ap, 6) AS ap FROM ap")
def official_ap(spark: SparkSession, d: str) -> DataFrame:
    return _by_chamfer(spark, d).withColumn("ap", F.round("ap", 6))


_MEANS = "SELECT threshold, round(avg(ap), 6) AS ap FROM ap GROUP BY threshold UNION ALL SELECT NULL, round(avg(ap), 6) FROM (SELECT avg(ap) AS ap FROM ap GROUP BY threshold)"


@query(f"{_BY_CHAMFER} {_MEANS}")
def apc_at_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return ev.mean_ap(_by_chamfer(spark, d)).withColumn("ap", F.round("ap", 6))


@query(f"{_BY_MASK} {_MEANS.replace('SELECT threshold', 'SELECT -threshold AS threshold', 1)}")
def apm_at_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return ev.mean_ap(_by_mask(spark, d)).withColumn("ap", F.round("ap", 6))


@query(f"WITH {fx.SIDES}, {_CHAMFER} SELECT sample, category, pred_idx, gt_idx, round(cost, 6) AS cost FROM cost")
def chamfer_metres(spark: SparkSession, d: str) -> DataFrame:
    return ev.chamfer_costs(*fx.sides(spark, d), METRES, STEP).withColumn("cost", F.round("cost", 6))
