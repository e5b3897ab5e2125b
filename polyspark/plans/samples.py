"""Queries of sample assembly over serialized lines: grammar, prompts, sequences and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.functions import geometry as g
from polyspark.functions import grammar, text, tokens
from polyspark.operators import batches
from polyspark.plans.catalogue import _IDS, _SERIAL, VOCAB, _encoded, _serialized
from polyspark.plans.registry import query

MAX_LEN = 128
BATCH = 8
MAX_LINES = 3
_GRAMMAR = grammar.Grammar(VOCAB, 2)

#: Every fourth sequence has one id replaced, so that failures are met as well.
_BROKEN = "broken AS (SELECT token, CASE WHEN token[7:]::BIGINT % 4 = 1 AND len(ids) >= 12 THEN list_concat(list_concat(ids[:9], [3]), ids[11:]) ELSE ids END AS ids FROM ids)"


_V = VOCAB
_WALK = f"""walk AS (
  SELECT token, ids, 1 AS n, 'between' AS st, 0 AS c, 0 AS lines, false AS bad FROM broken
  UNION ALL
  SELECT token, ids, n + 1, CASE WHEN bad THEN st WHEN nx IS NULL THEN st ELSE nx END,
         CASE WHEN bad OR nx IS NULL THEN c WHEN st = 'end' AND nx = 'x' THEN 0 WHEN st = 'y' THEN least(c + 1, 2) ELSE c END,
         lines + (i = {tokens.EOL})::INT, bad OR nx IS NULL
  FROM (SELECT *, CASE
      WHEN st = 'between' AND i = {tokens.LINE} THEN 'line'
      WHEN st = 'line' AND i BETWEEN 10 AND {_V.first_type - 1} THEN 'cat'
      WHEN st = 'cat' AND i BETWEEN {_V.first_type} AND {_V.first_start - 1} THEN 'type'
      WHEN st IN ('cat', 'type') AND i BETWEEN {_V.first_start} AND {_V.first_start + 1} THEN 'start'
      WHEN st = 'start' AND i BETWEEN {_V.first_start + 2} AND {_V.first_start + 3} THEN 'end'
      WHEN st = 'end' AND i = {tokens.PTS} THEN 'x'
      WHEN st IN ('x', 'xy') AND i BETWEEN {_V.first_x} AND {_V.first_y - 1} THEN 'y'
      WHEN st = 'y' AND i BETWEEN {_V.first_y} AND {_V.first_angle - 1} THEN 'xy'
      WHEN st = 'xy' AND i = {tokens.EOL} AND c >= 2 THEN 'between' END AS nx FROM (SELECT *, ids[n + 1] AS i FROM walk WHERE n < len(ids)))
), shown AS (
  SELECT token, n, CASE WHEN list_contains(ids[:n], {tokens.EOS}) THEN '2-2'
    WHEN st = 'between' THEN CASE WHEN lines >= {MAX_LINES} AND NOT bad THEN '2-2' ELSE '7-7 2-2' END
    WHEN st = 'line' THEN '10-{_V.first_type - 1}' WHEN st = 'cat' THEN '{_V.first_type}-{_V.first_start - 1} {_V.first_start}-{_V.first_start + 1}'
    WHEN st = 'type' THEN '{_V.first_start}-{_V.first_start + 1}' WHEN st = 'start' THEN '{_V.first_start + 2}-{_V.first_start + 3}' WHEN st = 'end' THEN '8-8'
    WHEN st = 'x' THEN '{_V.first_x}-{_V.first_y - 1}' WHEN st = 'y' THEN '{_V.first_y}-{_V.first_angle - 1}'
    WHEN c >= 2 THEN '{_V.first_x}-{_V.first_y - 1} 9-9' ELSE '{_V.first_x}-{_V.first_y - 1}' END AS allowed FROM walk
  UNION ALL SELECT token, 0, '1-1' FROM broken
)"""


@query(f"{_IDS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_BROKEN}, {_WALK} SELECT token, n::INT AS n, allowed FROM shown")
def grammar_valid(spark: SparkSession, d: str) -> DataFrame:
    ids = F.when((F.substring("token", 7, 20).cast("long") % 4 == 1) & (F.size("ids") >= 12), F.concat(F.slice("ids", 1, 9), F.array(F.lit(3)), F.slice("ids", 11, 1000))).otherwise(F.col("ids"))
    out = grammar.prefixes(_encoded(spark, d).select("token", ids.alias("ids")), _GRAMMAR, max_lines=MAX_LINES)
    shown = F.array_join(F.transform("allowed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), " ")
    return out.select("token", F.col("n").cast("int").alias("n"), shown.alias("allowed"))


def _q(c: str) -> str:
    return f"least(greatest(round_even({c}, 0), 0), 223)::INT"


_LONGEST = """len_of AS (
  SELECT *, list_sum(list_transform(range(1, len(points)), lambda i: sqrt((points[i + 1].x - points[i].x) ** 2 + (points[i + 1].y - points[i].y) ** 2))) AS length FROM ser WHERE len(points) >= 2
), target AS (SELECT token, points FROM len_of QUALIFY row_number() OVER (PARTITION BY token ORDER BY length DESC, rank) = 1)"""
_TRACE = f"""{_SERIAL}, {_LONGEST}, picked AS (
  SELECT token, points, list_transform(range(0, least(8, len(points))), lambda j: CASE WHEN j = least(8, len(points)) - 1 THEN len(points) - 1 ELSE floor(j * ((len(points) - 1)::DOUBLE / (least(8, len(points)) - 1)))::BIGINT END + 1) AS picks FROM target
), traced AS (
  SELECT token, [5] || flatten(list_transform(picks, lambda i: [22 + {_q('points[i].x')}, 246 + {_q('points[i].y')},
    470 + round_even((degrees(atan2(-(points[least(i + 1, len(points))].y - points[greatest(i - 1, 1)].y), points[least(i + 1, len(points))].x - points[greatest(i - 1, 1)].x)) + 360) % 360 * 359 / 360, 0)::INT])) || [6] AS prompt FROM picked
)"""


def _target(spark: SparkSession, d: str) -> DataFrame:
    """``token, points`` of the longest line of each patch."""
    rows = _serialized(spark, d).filter(F.size("points") >= 2).withColumn("length", g.length(F.col("points")))
    return rows.groupBy("token").agg(F.max_by("points", F.struct("length", (-F.col("rank")).alias("r"))).alias("points"))


def _joined(c) -> Column:
    return F.array_join(F.transform(c, lambda i: i.cast("string")), " ")


@query(f"{_TRACE} SELECT token, array_to_string(prompt, ' ') AS ids FROM traced")
def trace_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _target(spark, d).select("token", _joined(tokens.text_prompt(F.col("points"), "trace_points", VOCAB)).alias("ids"))


_SEQUENCES = f"""{_TRACE}, coded AS (
  SELECT token, rank, start_type = 'cut' OR end_type = 'cut' AS cut, [7, 9 + list_position({list(text.CATEGORIES)}, category)] || (CASE WHEN line_type = '' THEN [] ELSE [12 + list_position({list(text.LINE_TYPES)}, line_type)] END)
         || [CASE start_type WHEN 'cut' THEN 19 ELSE 18 END, CASE end_type WHEN 'cut' THEN 21 ELSE 20 END, 8]
         || flatten(list_transform(points, lambda p: [22 + {_q('p.x')}, 246 + {_q('p.y')}])) || [9] AS ids FROM ser
), cur AS (SELECT token, list_slice([1] || flatten(list(ids ORDER BY rank)), 1, 255) || [2] AS ids FROM coded GROUP BY token
), pre AS (
  SELECT token, flatten(list(ids ORDER BY rank)) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY rank) AS n FROM (
    SELECT *, max(cut) OVER (PARTITION BY token) AS any_cut FROM coded) WHERE cut OR NOT any_cut) WHERE n <= CASE WHEN any_cut THEN 2 ELSE least(8, 2) END GROUP BY token
), whole AS (
  SELECT token, (([1] || list_slice(p.ids, 1, 254) || [3]) || t.prompt) AS head, c.ids FROM cur c JOIN pre p USING (token) JOIN traced t USING (token)
), seqs AS (SELECT token, list_slice(head || ids[2:], 1, {MAX_LEN}) AS ids, least(len(head), len(list_slice(head || ids[2:], 1, {MAX_LEN})) - 1) AS start FROM whole
), packed AS (SELECT *, row_number() OVER (ORDER BY len(ids), token) - 1 AS n FROM seqs
), batched AS (SELECT token, ids, start, n // {BATCH} AS batch, n % {BATCH} AS slot, max(len(ids)) OVER (PARTITION BY n // {BATCH}) AS w FROM packed)"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("rank", "category", "line_type", "start_type", "end_type", "points")
    per = _serialized(spark, d).groupBy("token").agg(F.array_sort(F.collect_list(one)).alias("lines")).join(_target(spark, d), "token")
    lines = F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ("category", "line_type", "start_type", "end_type", "points")]))
    state = tokens.state_ids(lines, VOCAB, "cut_only", 2, 256)
    prompt = tokens.text_prompt(F.col("points"), "trace_points", VOCAB)
    ids, start = tokens.full_sequence(F.col("state"), F.col("prompt"), F.col("current"), MAX_LEN)
    per = per.select("token", state.alias("state"), prompt.alias("prompt"), tokens.encode(F.col("lines"), VOCAB, 256).alias("current"))
    return per.select("token", "state", "prompt", "current", ids.alias("ids"), start.alias("start"))


@query(f"{_SEQUENCES} SELECT token, start::INT AS start, array_to_string(ids, ' ') AS ids FROM seqs")
def full_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("token", "start", _joined("ids").alias("ids"))


@query(f"""{_SEQUENCES} SELECT token, batch, slot::INT AS slot, array_to_string(ids || list_transform(range(0, w - len(ids)), lambda i: 0), ' ') AS ids,
  array_to_string(list_transform(range(0, w - 1), lambda j: (j >= greatest(start - 1, 0) AND j < len(ids) - 1)::INT), '') AS loss_mask FROM batched""")
def loss_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = batches.pack(_sequences(spark, d).select("token", "ids", "start"), "ids", ["token"], BATCH)
    rows = batches.pad(batches.loss_mask(rows), {"ids": tokens.PAD})
    return rows.select("token", "batch", "slot", _joined("ids").alias("ids"), F.array_join(F.transform("loss_mask", lambda b: b.cast("int").cast("string")), "").alias("loss_mask"))


@query(f"""{_SEQUENCES}, cur2 AS (SELECT b.batch, b.slot, c.ids, t.prompt FROM batched b JOIN cur c USING (token) JOIN traced t USING (token)
), wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS w, max(len(prompt)) OVER (PARTITION BY batch) AS wp FROM cur2)
SELECT batch, string_agg(array_to_string(ids || list_transform(range(0, w - len(ids)), lambda i: 0), ' '), ';' ORDER BY slot) AS current, string_agg(array_to_string(prompt || list_transform(range(0, wp - len(prompt)), lambda i: 0), ' '), ';' ORDER BY slot) AS prompt,
  sum(len(ids))::BIGINT AS current_ids, sum(len(prompt))::BIGINT AS prompt_ids FROM wide GROUP BY batch""")
def collate_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = batches.pack(_sequences(spark, d).select("token", "ids", "prompt", "current"), "ids", ["token"], BATCH)
    rows = batches.pad(rows, {"current": tokens.PAD, "prompt": tokens.PAD})
    out = batches.collate(rows, ["current", "prompt", "current_mask", "prompt_mask"])
    shown = lambda c: F.array_join(F.transform(c, lambda r: _joined(r)), ";").alias(c)
    ones = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("batch", shown("current"), shown("prompt"), ones("current_mask").alias("current_ids"), ones("prompt_mask").alias("prompt_ids"))


TEMPLATE = "Map {categories} in {image_size} pixels, {state_prefix_count} lines known ({state_available})."


@query(f"""{_SERIAL}, n AS (SELECT token, count(*) FILTER (WHERE start_type = 'cut' OR end_type = 'cut') AS c FROM ser GROUP BY token)
SELECT token, 'Map curb, lane_line in 224 pixels, ' || c || ' lines known (' || CASE WHEN c > 0 THEN 'yes' ELSE 'no' END || '). ' || CASE WHEN c > 0 THEN '{text.WITH_STATE}' ELSE '{text.WITHOUT_STATE}' END || ' ' || '{text.WITH_TYPES.format("solid, dashed")}' AS prompt FROM n""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    cut = F.count_if((F.col("start_type") == "cut") | (F.col("end_type") == "cut")).alias("c")
    rows = _serialized(spark, d).groupBy("token").agg(cut)
    return rows.select("token", text.prompt_text(TEMPLATE, F.col("c"), {"categories": "curb, lane_line", "image_size": 224}, ("solid", "dashed")).alias("prompt"))
