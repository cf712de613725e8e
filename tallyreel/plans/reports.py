"""The five pattern reports, one row per group.

Upload times, format comparison and title patterns are three sets of aggregates
over the same few profile rows, so any combination costs one pass over the data.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.functions import clock, figures, titles
from tallyreel.operators import engagement
from tallyreel.operators.grouping import beside
from tallyreel.operators.totals import (
    described_videos,
    level_value,
    profile,
    profile_rows,
    traffic_shares,
    video_totals,
)
from tallyreel.schemas import DAY_NAMES

UPLOAD_DIMENSIONS = ["hour", "weekday"]
FORMAT_DIMENSIONS = ["short"]
TITLE_DIMENSIONS = ["all", "non_ascii", "exclamation", "question", "length_bucket"]


def _of(dimension: str, value: Column) -> Column:
    return F.when(F.col("dimension") == dimension, value)


def _mean_then(sign: int) -> Column:
    return F.struct(F.col("mean_views"), (F.col("level") * sign).alias("tie"))


def _best(dimension: str) -> Column:
    """Level with the highest mean; equal means keep the lower level."""
    return F.max_by(_of(dimension, F.col("level")), _of(dimension, _mean_then(-1)))


def _worst(dimension: str) -> Column:
    return F.min_by(_of(dimension, F.col("level")), _of(dimension, _mean_then(1)))


def _highest(dimension: str) -> Column:
    return figures.whole(F.max(_of(dimension, F.col("mean_views"))))


def upload_columns() -> list[Column]:
    # At most 24 hours and 7 days per group reach these lists.
    hours = F.collect_list(_of("hour", F.struct((-F.col("mean_views")).alias("m"), "level")))
    first_three = F.transform(F.slice(F.array_sort(hours), 1, 3), lambda h: h["level"])
    hour_pairs = F.collect_list(_of("hour", F.struct("level", "mean_views")))
    day_means = [
        level_value("weekday", i, "mean_views", absent="NULL") for i in range(len(DAY_NAMES))
    ]
    return [
        _best("hour").alias("best_hour"),
        _worst("hour").alias("worst_hour"),
        clock.weekday_name(_best("weekday")).alias("best_day"),
        clock.weekday_name(_worst("weekday")).alias("worst_day"),
        first_three.alias("top_3_hours"),
        _highest("hour").alias("best_hour_avg_views"),
        _highest("weekday").alias("best_day_avg_views"),
        F.map_from_entries(F.array_sort(hour_pairs)).alias("hour_data"),
        F.map_from_arrays(F.array(*[F.lit(d) for d in DAY_NAMES]), F.array(*day_means)).alias(
            "day_data"
        ),
    ]


def format_columns() -> list[Column]:
    shorts = level_value("short", 1, "mean_views")
    longs = level_value("short", 0, "mean_views")
    return [
        figures.whole(shorts).alias("avg_views_shorts"),
        figures.whole(longs).alias("avg_views_longform"),
        F.when(shorts > longs, "Shorts").otherwise("Long-form").alias("better_format"),
        F.bround(F.when(longs > 0, figures.ratio(shorts, longs)).otherwise(F.lit(1.0)), 2).alias(
            "multiplier"
        ),
        (longs > 0).alias("has_baseline"),
        level_value("short", 1, "videos").alias("total_shorts"),
        level_value("short", 0, "videos").alias("total_longform"),
        level_value("short", 1, "views").alias("shorts_total_views"),
        level_value("short", 0, "views").alias("longform_total_views"),
    ]


def title_columns() -> list[Column]:
    out = []
    for flag, name in [
        ("non_ascii", "emoji"),
        ("exclamation", "exclamation"),
        ("question", "question"),
    ]:
        with_it, without = (level_value(flag, x, "mean_views") for x in (1, 0))
        out += [
            (with_it > without).alias(f"{name}_helps"),
            figures.whole(with_it).alias(f"avg_views_with_{name}"),
            figures.whole(without).alias(f"avg_views_without_{name}"),
        ]
    buckets = F.array_sort(
        F.collect_list(_of("length_bucket", F.struct("level", "mean_views")))
    )
    named = F.transform(
        buckets,
        lambda b: F.struct(titles.length_bucket_name(b["level"]), figures.whole(b["mean_views"])),
    )
    chars = F.sum(_of("all", F.col("title_chars")))
    titled = F.sum(_of("all", F.col("titled")))
    return out + [
        titles.length_bucket_name(_best("length_bucket")).alias("best_title_length_bucket"),
        F.map_from_entries(named).alias("length_performance"),
        F.bround(figures.ratio(chars, titled), 1).alias("avg_title_length"),
    ]


def upload_times(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best and worst publish hour and weekday by mean lifetime views."""
    return profile(videos, video_totals(daily), UPLOAD_DIMENSIONS, by).groupBy(*by).agg(*upload_columns())


def video_length(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shorts against long-form. Equal means count as long-form, no long-form as 1.0."""
    return profile(videos, video_totals(daily), FORMAT_DIMENSIONS, by).groupBy(*by).agg(*format_columns())


def title_patterns(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Title features against mean lifetime views."""
    return profile(videos, video_totals(daily), TITLE_DIMENSIONS, by).groupBy(*by).agg(*title_columns())


def traffic(
    traffic_sources: DataFrame, videos: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Sources with views and percent, most views first.

    The source type is a short fixed vocabulary, so a group's list is small. A group
    without traffic gives no row.
    """
    shares = traffic_shares(traffic_sources, videos, by)
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("total_views")).alias("o"), "traffic_source_type", "total_views", "percentage"
            )
        )
    )
    listed = shares.groupBy(*by).agg(ordered.alias("s")).filter(F.size("s") > 0)
    return listed.select(
        *by,
        F.col("s")[0]["traffic_source_type"].alias("top_source"),
        F.col("s")[0]["percentage"].alias("top_source_percentage"),
        F.map_from_entries(
            F.transform(
                "s",
                lambda x: F.struct(
                    x["traffic_source_type"],
                    F.struct(x["total_views"].alias("total_views"), x["percentage"].alias("percentage")),
                ),
            )
        ).alias("sources"),
        F.transform(F.slice("s", 1, 3), lambda x: x["traffic_source_type"]).alias("top_3_sources"),
    )


def weak_engagement(
    videos: DataFrame,
    daily: DataFrame,
    n: int = engagement.WEAK_VIDEOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Retention baseline, how many videos are under it, and the n lowest of those."""
    return weak_report(engagement.settled_engagement(videos, daily, by), n, by)


def weak_report(
    engaged: DataFrame, n: int = engagement.WEAK_VIDEOS, by: Sequence[str] = ()
) -> DataFrame:
    worst = engagement.weak_videos(engaged, n, by)
    shown = ["video_id", "title", "avg_retention", "total_views", "net_subs", "below_avg_by"]
    # At most n videos per group.
    in_order = F.array_sort(F.collect_list(F.struct("_order", *shown)))
    listed = worst.groupBy(*by).agg(
        F.transform(in_order, lambda v: F.struct(*[v[c].alias(c) for c in shown])).alias(
            "weak_videos"
        )
    )
    return beside(engagement.weak_summary(engaged, by), [listed], by)


def all_patterns(
    videos: DataFrame,
    daily: DataFrame,
    traffic_sources: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """All five reports as nested columns of one row per group.

    Facts and videos are scanned and joined once, and the joined rows feed every
    report but traffic.
    """
    dimensions = [*UPLOAD_DIMENSIONS, *FORMAT_DIMENSIONS, *TITLE_DIMENSIONS]
    described = described_videos(videos, daily, dimensions, by)
    patterns = profile_rows(described, dimensions, by).groupBy(*by).agg(
        F.struct(*upload_columns()).alias("upload_times"),
        F.struct(*format_columns()).alias("video_length"),
        F.struct(*title_columns()).alias("title_patterns"),
    )

    def nested(report, name):
        inner = [c for c in report.columns if c not in by]
        return report.select(*by, F.struct(*inner).alias(name))

    weak = weak_report(engagement.engaged_of(described, by), by=by)
    return beside(
        patterns,
        [nested(traffic(traffic_sources, videos, by), "traffic"), nested(weak, "weak_engagement")],
        by,
    ).select(
        *by, "upload_times", "video_length", "traffic", "weak_engagement", "title_patterns"
    )


def kpi_tiles(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headline figures as display text."""
    described = described_videos(videos, daily, FORMAT_DIMENSIONS, by)
    formats = profile_rows(described, FORMAT_DIMENSIONS, by).groupBy(*by).agg(*format_columns())
    weak = engagement.weak_summary(engagement.engaged_of(described, by), by)
    return tiles(formats, weak, by)


def tiles(formats: DataFrame, weak: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tiles from the format report and the summary of weak videos."""
    retention = F.coalesce("channel_avg_retention", F.lit(0.0)).cast("string")
    return beside(
        formats.select(*by, "total_shorts", "total_longform", "better_format"), [weak], by
    ).select(
        *by,
        figures.compact_number(F.col("total_shorts")).alias("total_shorts"),
        figures.compact_number(F.col("total_longform")).alias("total_longform"),
        "better_format",
        F.concat(F.regexp_replace(retention, r"\.0$", ""), F.lit("%")).alias("avg_retention"),
        figures.compact_number(F.col("total_weak_count")).alias("weak_videos"),
    )
