"""Helpers that make each report work for one global group or for many.

``by`` is a list of grouping columns. The empty list means one global answer.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Copies of each per-group summary row, and so the number of tasks over which the
# rows of one hot group are spread when the summary is too large to broadcast.
SPREAD = 64


def attach(
    rows: DataFrame, summary: DataFrame, by: Sequence[str], spread_on: Sequence[str]
) -> DataFrame:
    """Add a group's summary columns to each row; every row is kept.

    Rows of a group without a summary get nulls, as they do from an empty global
    summary. A global summary is one row, read as a scalar subquery. A per-group summary is
    joined on the group and a salt, so a group holding a large share of the rows
    does not land in one task. The join side is left to Spark's size estimate.
    """
    if not by:
        whole = summary.select(F.struct(*summary.columns).alias("s")).scalar()
        return rows.select("*", whole.alias("_summary")).select(*rows.columns, "_summary.*")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    copies = summary.withColumn("_salt", salts)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(SPREAD)).cast("int"))
    return salted.join(copies, [*by, "_salt"], "left").drop("_salt")


def beside(rows: DataFrame, summaries: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Put per-group summaries next to rows that are few per group.

    Every row is kept; columns of a missing group are null. Use ``attach`` for rows
    whose groups may be large.
    """
    for summary in summaries:
        if by:
            rows = rows.join(summary, list(by), "left")
        else:
            part = summary.select(F.struct(*summary.columns).alias("s")).scalar()
            rows = rows.select("*", part.alias("_part")).select(*rows.columns, "_part.*")
    return rows


def top_n(rows: DataFrame, order: Sequence[Column], n: int, by: Sequence[str]) -> DataFrame:
    """The first n rows of each group.

    Globally this is a top-k over partitions. Per group the rank filter becomes a
    group limit below the shuffle, so each task sends at most n rows per group.
    """
    if not by:
        return rows.orderBy(*order).limit(n)
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def with_group_columns(
    facts: DataFrame, videos: DataFrame, by: Sequence[str], columns: Sequence[str] = ()
) -> DataFrame:
    """Inner join of rows keyed by video with the dimension columns a report needs."""
    wanted = list(dict.fromkeys([*by, *columns]))
    return facts.join(videos.select("video_id", *wanted), "video_id")
