"""Tables behind the charts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreel.functions import clock, figures
from tallyreel.operators.grouping import beside
from tallyreel.operators.ranking import top_sources
from tallyreel.operators.totals import mean_views_by, mean_views_by_weekday

CHART_SOURCES = 6


def traffic_chart(
    traffic: DataFrame, videos: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The six largest sources and each one's whole percent of those six."""
    shown = top_sources(traffic, CHART_SOURCES, videos, by).select(
        *by, "traffic_source_type", "total_views"
    )
    total = shown.groupBy(*by).agg(F.sum("total_views").alias("_shown"))
    part = figures.ratio(F.col("total_views"), F.col("_shown")) * 100
    return beside(shown, [total], by).select(
        *by,
        figures.display_name(F.col("traffic_source_type")).alias("name"),
        F.col("total_views").alias("value"),
        F.floor(part + 0.5).cast("bigint").alias("percent_of_shown"),
    )


def _with_best(means: DataFrame, level: str, by: Sequence[str]) -> DataFrame:
    """Level means with the group's best level; a group has 24 levels at most."""
    order = F.struct(F.col("mean_views"), (-F.col(level)).alias("tie"))
    known = F.when(F.col("mean_views").isNotNull(), order)
    return (
        means.groupBy(*by)
        .agg(
            F.collect_list(F.struct(level, "mean_views")).alias("_levels"),
            F.max_by(level, known).alias("_best"),
        )
        .select(*by, "_best", F.inline("_levels"))
    )


def hours_chart(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean views per publish hour with the best hour marked."""
    marked = _with_best(mean_views_by(videos, daily, "hour", by), "level", by)
    return marked.select(
        *by,
        F.concat(F.col("level").cast("string"), F.lit(":00")).alias("hour"),
        F.col("mean_views").alias("views"),
        (F.col("level") == F.col("_best")).alias("is_max"),
        F.col("level").alias("position"),
    ).orderBy(*by, "position")


def days_chart(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean views per weekday, Monday first, 0 where nothing was published."""
    marked = _with_best(mean_views_by_weekday(videos, daily, by), "weekday", by)
    return marked.select(
        *by,
        F.substring(clock.weekday_name(F.col("weekday")), 1, 3).alias("day"),
        F.coalesce("mean_views", F.lit(0.0)).alias("views"),
        (F.col("weekday") == F.col("_best")).alias("is_max"),
        F.col("weekday").alias("position"),
    ).orderBy(*by, "position")
