"""Constraint checks for tables whose format enforces none."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one pass over the rows."""
    counted = rows.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return counted.unpivot([], list(columns), "column_name", "nulls")


def orphans(facts: DataFrame, videos: DataFrame) -> DataFrame:
    """Fact rows whose video is unknown."""
    return facts.join(videos.select("video_id"), "video_id", "left_anti")
