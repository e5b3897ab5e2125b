"""What training loops report and decide row by row: weighted losses, accuracies, epochs and dropped modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_loss(rows: DataFrame, group: list[str], loss: str, tokens: str, correct: Column) -> DataFrame:
    """``group, weighted_loss, token_accuracy``: losses weighted by their tokens, and the share of rows that are ``correct``."""
    mean = F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))
    return rows.groupBy(*group).agg(mean.alias("weighted_loss"), (F.count_if(correct) / F.count("*")).alias("token_accuracy"))


def epoch_report(rows: DataFrame, epoch: str, means: list[str], ratios: list[str]) -> DataFrame:
    """A row for each epoch: its steps, the mean of each of ``means`` and the share of steps in which each flag of ``ratios`` holds."""
    share = lambda c: (F.count_if(F.col(c)) / F.count("*")).alias(f"{c}_ratio")
    return rows.groupBy(epoch).agg(F.count("*").alias("steps"), *[F.avg(c).alias(c) for c in means], *[share(c) for c in ratios])


def modality_mask(key: Column, seed: int, first: float, second: float) -> tuple[Column, Column]:
    """Which of two modalities stay: each goes with its probability by a seeded hash of the key; where the first goes the second stays.

    Probabilities are taken in sixteenths. A row has the same answer in every run and every partitioning.
    """
    digits = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    stays = lambda k, p: F.substring(digits, k, 1) >= f"{min(15, round(p * 16)):x}"
    image = stays(1, first)
    return image, ~image | stays(2, second)
