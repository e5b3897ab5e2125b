"""Steps that are written before they are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session (tests) without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what a range partitioning or a running number decided stays decided."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``df`` with ``name``, the place of each row (from 0) in ``order`` over the whole table.

    Rows are sorted by range; a partition's numbers begin where those before it end, so no task sees more than its own
    partition, and the offsets are one row for each partition.
    """
    place = "__place"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = settled(rows, "numbered").withColumn("__part", F.shiftright(place, 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__rows"), F.min(place).alias("__first"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__start"))
    rows = rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col(place) - F.col("__first"))
    return rows.drop("__part", "__first", "__start", place)
