"""Derived rows kept under a signature of what they were derived from: only what is missing is computed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(settings: dict) -> str:
    """16 hex digits of the SHA-1 of the settings as JSON with sorted keys: equal for equal settings, whatever their order."""
    return hashlib.sha1(json.dumps(settings, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def row_signature(*columns: str) -> Column:
    """As ``signature`` for the named columns of a row; nulls count."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.substring(F.sha1(body.cast("binary")), 1, 16)


def stored(spark: SparkSession, path: str, sign: str) -> DataFrame | None:
    """What is kept under a signature, or none. A folder that is no readable table counts as none."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/signature={sign}")
    except AnalysisException:
        return None


def read_through(keys: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, sign: str) -> DataFrame:
    """The rows of ``compute`` for all ``keys`` (one or more columns), of which only the missing ones are computed.

    Missing keys are found by an anti-join and their rows are appended by one committed write, so a failed run leaves nothing
    half done and the next one computes it again. A key for which ``compute`` gives no row is computed each time.
    """
    spark, on = keys.sparkSession, keys.columns
    keys = keys.distinct()
    known = stored(spark, path, sign)
    missing = keys if known is None else keys.join(known.select(*on).distinct(), on, "left_anti")
    if known is None or not missing.isEmpty():
        compute(missing).write.mode("append").parquet(f"{path.rstrip('/')}/signature={sign}")
        known = stored(spark, path, sign)
    return known.join(keys, on, "left_semi")
