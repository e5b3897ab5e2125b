"""Views of the driver's tables as map data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RAW_TYPES = ("Solid", "thick-solid", "Dashed", "short_dashed", "Others", "none", "", "zigzag")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, token, line_idx, category, line_type, points``: 32 points in metres for each embedding."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) = 64")
    kind = F.when(F.col("label") % 3 == 0, "Lane line").when(F.col("label") % 3 == 1, "Curb").otherwise("Virtual line")
    at = lambda i: F.get("embedding", i).cast("double") * 150
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    raw = F.get(F.array(*map(F.lit, RAW_TYPES)), (F.col("vec_id") % 8).cast("int"))
    return e.select("vec_id", F.concat(F.lit("patch_"), F.expr("vec_id DIV 10")).alias("token"), (F.col("vec_id") % 10).cast("int").alias("line_idx"), kind.alias("category"), raw.alias("line_type"), points.alias("points"))


LINES = f"""lines AS (
  SELECT vec_id, 'patch_' || (vec_id // 10)::VARCHAR AS token, (vec_id % 10)::INT AS line_idx,
         CASE label % 3 WHEN 0 THEN 'Lane line' WHEN 1 THEN 'Curb' ELSE 'Virtual line' END AS category,
         [{', '.join(f"'{t}'" for t in RAW_TYPES)}][vec_id % 8 + 1] AS line_type,
         list_transform(range(0, 32), lambda i: {{'x': embedding[2 * i + 1]::DOUBLE * 150, 'y': embedding[2 * i + 2]::DOUBLE * 150}}) AS points
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64
)"""

#: Length of a line and arc length at each vertex.
CUM = """seg AS (
  SELECT *, list_transform(range(1, len(points)), lambda i: sqrt((points[i + 1].x - points[i].x) ** 2 + (points[i + 1].y - points[i].y) ** 2)) AS s FROM lines
), cum AS (
  SELECT *, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_slice(s, 1, i)), 0.0::DOUBLE)) AS c FROM seg
)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of odd and of even number as predictions and truth."""
    rows = lines(spark, sf_dir).withColumn("sample", F.expr("vec_id DIV 10"))
    return rows.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "pred_idx"), rows.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "gt_idx")


SIDES = LINES + """, pred AS (SELECT vec_id // 10 AS sample, vec_id AS pred_idx, category, points FROM lines WHERE vec_id % 2 = 1
), gt AS (SELECT vec_id // 10 AS sample, vec_id AS gt_idx, category, points FROM lines WHERE vec_id % 2 = 0)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, lon, lat, scene, x_min, y_min, size, tile`` for each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust_"), k).alias("token"), (0.0005 * (k % 40)).alias("lon"), (0.0005 * F.floor(k / 40)).alias("lat"), F.col("c_nationkey").alias("scene"),
        (448 * (k % 8)).alias("x_min"), (448 * (F.floor(k / 8) % 8)).alias("y_min"), F.lit(896).alias("size"), F.concat(F.lit("tile_"), F.floor(k / 64)).alias("tile"),
    )


PATCHES = """patches AS (
  SELECT 'cust_' || c_custkey AS token, 0.0005::DOUBLE * (c_custkey % 40) AS lon, 0.0005::DOUBLE * (c_custkey // 40) AS lat, c_nationkey AS scene,
         448 * (c_custkey % 8) AS x_min, 448 * (c_custkey // 8 % 8) AS y_min, 896 AS size, 'tile_' || (c_custkey // 64) AS tile FROM customer
)"""
