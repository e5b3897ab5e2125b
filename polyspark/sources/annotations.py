"""Readers and writers of annotation, geometry, split and prediction files.

Files hold one JSON object with a key for each record; they are read whole and exploded. Records that do not fit the
schema are dropped, as are records without what the reader needs; missing sizes get the reader's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.functions.text import gps, token_key
from polyspark.operators.snapshot import in_order

_POINTS = "array<array<double>>"
ANNOTATION = f"struct<image_width:int,image_height:int,source_image:string,source_split:string,city:string,lines:array<struct<category:string,line_type:string,points:{_POINTS}>>>"
GEOMETRY = "struct<sample_token:string,gps_center:array<double>,image_width:int,image_height:int,crop_region:struct<x_min:int,y_min:int,x_max:int,y_max:int,original_image:string,source_split:string,city:string>>"
SPLITS = "struct<train_tokens:array<string>,val_tokens:array<string>,test_tokens:array<string>>"
GRID = "map<string, array<struct<centerGPS:string>>>"
_LINE = f"struct<category:string,line_type:string,start_type:string,end_type:string,score:double,line_score:double,pseudo_score:double,points:{_POINTS}>"
PREDICTIONS = f"token string, pred_lines array<{_LINE}>, gt_lines array<{_LINE}>"


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("v"))


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``name, a`` of each key; a record that is no object is null."""
    rows = _whole(spark, path, "map<string,string>").select(F.explode("v").alias("name", "text"))
    return rows.select("name", F.from_json("text", schema).alias("a"))


def _xy(points):
    return F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_annotations(spark: SparkSession, path: str, default_size: int = 4096) -> DataFrame:
    """``token, line_idx, image_width, image_height, source_image, city, category, line_type, points``, a row for each line."""
    rows = _records(spark, path, ANNOTATION)
    size = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(default_size)).alias(c)
    rows = rows.select(token_key(F.col("name")).alias("token"), size("image_width"), size("image_height"), "a.source_image", "a.city", F.posexplode("a.lines").alias("line_idx", "l"))
    return rows.select("token", "line_idx", "image_width", "image_height", "source_image", "city", "l.category", "l.line_type", _xy(F.col("l.points")).alias("points"))


def read_patch_geometry(spark: SparkSession, path: str) -> DataFrame:
    """``token, lon, lat, image_width, image_height, crop_region``; records without a position go."""
    rows = _records(spark, path, GEOMETRY).filter(F.size("a.gps_center") >= 2)
    size = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(512)).alias(c)
    token = token_key(F.coalesce("a.sample_token", "name")).alias("token")
    return rows.select(token, F.get("a.gps_center", F.lit(0)).alias("lon"), F.get("a.gps_center", F.lit(1)).alias("lat"), size("image_width"), size("image_height"), "a.crop_region")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``split, pos, token``."""
    v = _whole(spark, path, SPLITS)
    parts = [v.select(F.lit(s).alias("split"), F.posexplode(f"v.{s}_tokens").alias("pos", "token")) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_gps_grid(spark: SparkSession, path: str) -> DataFrame:
    """``image, lon, lat`` of every cell."""
    cells = _whole(spark, path, GRID).select(F.explode("v").alias("image", "c")).select("image", F.explode("c").alias("c"))
    lon, lat = gps(F.col("c.centerGPS"))
    return cells.select("image", lon.alias("lon"), lat.alias("lat"))


def read_predictions(spark: SparkSession, path: str, side: str = "pred", by_line: bool = False) -> DataFrame:
    """``sample, pred_idx, category, line_type, score, fallback, points`` of a prediction file; ``fallback``: the line has no score.

    The file is a JSON array, or with ``by_line`` has an object a line, as ``write_predictions`` leaves it.
    """
    rows = spark.read.schema(PREDICTIONS).json(path, multiLine=not by_line).select(F.col("token").alias("sample"), F.posexplode(f"{side}_lines").alias(f"{side}_idx", "l"))
    score = F.coalesce("l.score", "l.line_score", "l.pseudo_score")
    return rows.select("sample", f"{side}_idx", "l.category", "l.line_type", F.coalesce(score, F.lit(1.0)).alias("score"), score.isNull().alias("fallback"), _xy(F.col("l.points")).alias("points"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, token, length`` of the files under a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", token_key(F.element_at(F.split("path", "/"), -1)).alias("token"), "length")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of Parquet for each table of a snapshot (annotations, splits, patch geometry, manifest, summary)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def append_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def metrics_markdown(row: dict[str, float]) -> str:
    """A two-column table of one row of metrics."""
    return "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {v:.6g} |" for k, v in row.items())])


def prediction_records(samples: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``token, pred_lines, gt_lines``: each sample's lines (``sample, pred_idx`` or ``gt_idx``, a line and, for predictions, ``score``) in their order."""

    def side(df: DataFrame, idx: str, name: str) -> DataFrame:
        fields = [c for c in ("category", "line_type", "start_type", "end_type", "score") if c in df.columns]
        one = F.struct(idx, F.struct(*fields, F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("points")).alias("l"))
        return df.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l"]).alias(name))

    rows = samples.select("sample").distinct().join(side(pred, "pred_idx", "pred_lines"), "sample", "left").join(side(gt, "gt_idx", "gt_lines"), "sample", "left")
    filled = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(F.col("sample").alias("token"), filled("pred_lines"), filled("gt_lines"))


def write_predictions(records: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are tasks."""
    records.write.mode("overwrite").json(path)


def strict_objects(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of each key of files that hold one JSON object; a file that holds anything else is an error that names it."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "map<string,string>").alias("v"))
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), "file"))
    return rows.select(F.explode(F.when(F.col("v").isNull(), wrong.cast("map<string,string>")).otherwise(F.col("v"))).alias("name", "text"))


def scan_annotations(spark: SparkSession, path: str, images: DataFrame, order: DataFrame | None = None, most: int | None = None, default_size: int = 4096) -> DataFrame:
    """``read_annotations`` of the images that are there (``token``), with ``place``: by the external order ``token, pos`` where given, else by name; the first ``most`` images stay."""
    lines = read_annotations(spark, path, default_size)
    there = lines.select("token").distinct().join(images.select("token").distinct(), "token", "left_semi")
    order = order if order is not None else spark.createDataFrame([], "token string, pos int")
    return lines.join(in_order(there, order, "token", most), "token")


def list_long_tokens(spark: SparkSession, path: str, pattern: str = "*.pkl", length: int = 36) -> DataFrame:
    """``token, path`` of files whose names have ``length`` characters; of a token that is there twice the later path holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(F.length(name) == length).select(F.regexp_replace(name, "\\.[^.]*$", "").alias("token"), "path")
    return files.groupBy("token").agg(F.max("path").alias("path"))
