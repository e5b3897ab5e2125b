"""Training batches: rows of like length, padded to the longest of their batch, with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.operators.stages import numbered


def pack(rows: DataFrame, ids: str, key: list[str], size: int) -> DataFrame:
    """Adds ``batch`` and ``slot``: rows in the order of length and ``key``, ``size`` to a batch, so little is padded.

    Numbers come from range partitions with offsets by partition: no window over all rows, and a batch may lie across two partitions.
    """
    length = "__length"
    out = numbered(rows.withColumn(length, F.size(ids)), [length, *key], "__n").drop(length)
    return out.withColumns({"batch": F.expr(f"__n DIV {size}"), "slot": (F.col("__n") % size).cast("int")}).drop("__n")


def _filled(ids: Column, to: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), to - F.size(ids)))


def pad(rows: DataFrame, columns: dict[str, int], batch: str = "batch") -> DataFrame:
    """Every column of ids filled to the longest of its batch with its pad, and ``{column}_mask`` (1 for ids, 0 for what is filled)."""
    by = Window.partitionBy(batch)
    out = rows.withColumns({f"__{c}": F.max(F.size(c)).over(by) for c in columns})
    for c, p in columns.items():
        mask = F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), F.col(f"__{c}") - F.size(c)))
        out = out.withColumn(f"{c}_mask", mask).withColumn(c, _filled(F.col(c), F.col(f"__{c}"), p))
    return out.drop(*[f"__{c}" for c in columns])


def loss_mask(rows: DataFrame, ids: str = "ids", start: str = "start", batch: str = "batch") -> DataFrame:
    """Adds ``loss_mask``: for each target (the ids from the second on, filled to the longest of the batch) whether it counts.

    Targets from the first id of the current part to the last id count; what is filled does not.
    """
    width = F.max(F.size(ids)).over(Window.partitionBy(batch)) - 1
    at = F.sequence(F.lit(0), F.col("__w") - 1)
    counts = F.transform(at, lambda j: (j >= F.greatest(F.col(start) - 1, F.lit(0))) & (j < F.size(ids) - 1))
    mask = F.when(F.col("__w") > 0, counts).otherwise(F.array().cast("array<boolean>"))
    return rows.withColumn("__w", width).withColumn("loss_mask", mask).drop("__w")


def collate(rows: DataFrame, columns: list[str], batch: str = "batch", slot: str = "slot") -> DataFrame:
    """One row for each batch: each column becomes an array over its slots. A batch has a fixed number of rows."""
    one = F.array_sort(F.collect_list(F.struct(slot, *columns)))
    per = rows.groupBy(batch).agg(one.alias("__rows"))
    return per.select(batch, *[F.col("__rows").getField(c).alias(c) for c in columns])
