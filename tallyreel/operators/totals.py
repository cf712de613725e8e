"""Totals per video and per source, daily series, and one-key means."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.functions import clock, exact, figures, titles
from tallyreel.operators.grouping import beside, with_group_columns
from tallyreel.sources.store import settle

# Days until a figure is final at the source, the default length of a series, and the
# days after publication that count as the first week.
SOURCE_DELAY_DAYS = 2
SERIES_DAYS = 30
FIRST_WEEK_DAYS = 7

# Retention of days that were watched at all, null for others.
WATCHED_PERCENTAGE = "CASE WHEN average_view_percentage > 0 THEN average_view_percentage END"


def video_facts(daily: DataFrame) -> DataFrame:
    """Everything the reports need per video, from one pass over the fact.

    Retention is the plain mean over watched days, those with retention above zero;
    watched views and net subscribers cover the same days. Aggregates that a report
    does not read are pruned, and their columns are not scanned.

    Retention is compared and ranked, so its mean is exact up to one rounding: equal stays
    equal, and unlike stays unlike, under any partitioning.
    """
    watched = F.col("average_view_percentage") > 0

    def over_watched(name: str) -> Column:
        return F.when(watched, F.col(name))

    return daily.groupBy("video_id").agg(
        F.sum("views").alias("total_views"),
        exact.mean(WATCHED_PERCENTAGE).alias("avg_retention"),
        F.sum(over_watched("views")).alias("watched_views"),
        (
            F.sum(over_watched("subscribers_gained")) - F.sum(over_watched("subscribers_lost"))
        ).alias("net_subs"),
    )


def video_totals(daily: DataFrame) -> DataFrame:
    """Lifetime views per video."""
    return video_facts(daily).select("video_id", "total_views")


def videos_with_totals(
    videos: DataFrame, facts: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Videos that have metrics, with their lifetime views.

    The fact is aggregated first: its partial sums shrink a busy video to one row
    per task, and the join reuses the partitioning of that aggregate.
    """
    return with_group_columns(facts.select("video_id", "total_views"), videos, by, columns)


# Level of each profile dimension, as an integer made from one column of the video.
PROFILE_DIMENSIONS = {
    "all": lambda: F.lit(0),
    "hour": lambda: clock.publish_hour(F.col("published_at")),
    "weekday": lambda: clock.weekday_number(F.col("published_at")),
    "short": lambda: F.col("is_short"),
    "non_ascii": lambda: titles.has_non_ascii(F.col("title")),
    "exclamation": lambda: titles.has_exclamation(F.col("title")),
    "question": lambda: titles.has_question(F.col("title")),
    "length_bucket": lambda: titles.length_bucket_number(F.col("title")),
}


def profile(
    videos: DataFrame,
    facts: DataFrame,
    dimensions: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (group, dimension, level): videos, views and mean views.

    Levels are computed before the join, so titles are not shuffled. All dimensions
    come out of one pass: unpivoted rows meet a partial aggregate in the same stage,
    so a task sends at most one row per group and level (43 levels over all
    dimensions) however many videos it read.
    """
    described = videos.select("video_id", *by, *described_levels(dimensions))
    joined = facts.select("video_id", "total_views").join(described, "video_id")
    return profile_rows(joined, dimensions, by)


def described_levels(dimensions: Sequence[str]) -> list[Column]:
    """What a video's own row says: its title's length and its level in each dimension."""
    # Title lengths are only needed in the row that covers all videos.
    length = titles.title_length(F.col("title")) if "all" in dimensions else F.lit(None)
    return [
        length.cast("bigint").alias("title_chars"),
        *[PROFILE_DIMENSIONS[d]().cast("bigint").alias(d) for d in dimensions],
    ]


def described_videos(
    videos: DataFrame, daily: DataFrame, dimensions: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per video with facts, group, title and profile levels, computed once.

    The fact is scanned and joined once; every report of a set then reads these rows, of
    which there are as many as videos.
    """
    levels = videos.select("video_id", *by, "title", *described_levels(dimensions))
    return settle(video_facts(daily).join(levels, "video_id"), "described")


def profile_rows(joined: DataFrame, dimensions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The profile of videos that carry their levels."""
    long = joined.select(*by, "total_views", "title_chars", *dimensions).unpivot(
        [*by, "total_views", "title_chars"], list(dimensions), "dimension", "level"
    )
    return (
        long.filter(F.col("level").isNotNull())
        .groupBy(*by, "dimension", "level")
        .agg(
            F.count("*").alias("videos"),
            F.sum("total_views").alias("views"),
            F.sum("title_chars").alias("title_chars"),
            F.count("title_chars").alias("titled"),
        )
        .withColumn("mean_views", figures.ratio(F.col("views"), F.col("videos")))
    )


def mean_views_by(
    videos: DataFrame, daily: DataFrame, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean lifetime views per level of one dimension; levels with no video are absent."""
    return profile(videos, video_totals(daily), [dimension], by).select(
        *by, "level", "videos", "views", "mean_views"
    )


def mean_views_by_weekday(
    videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean views for all seven weekdays, null where nothing was published.

    A group's means, seven at most, become a map that the full week looks into, so
    the means are computed once rather than again for the list of groups.
    """
    known = F.map_from_entries(F.collect_list(F.struct("level", "mean_views")))
    week = F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))
    return (
        mean_views_by(videos, daily, "weekday", by)
        .groupBy(*by)
        .agg(known.alias("_known"))
        .select(*by, "_known", F.explode(week).alias("weekday"))
        .select(
            *by,
            "weekday",
            clock.weekday_name(F.col("weekday")).alias("day"),
            F.try_element_at("_known", F.col("weekday")).alias("mean_views"),
        )
    )


def level_value(dimension: str, level: int, column: str, absent: str = "0") -> Column:
    """Aggregate over profile rows: one level's figure, or ``absent`` without that level."""
    here = f"dimension = '{dimension}' AND level = {level}"
    return F.expr(f"coalesce(max(CASE WHEN {here} THEN {column} END), {absent})")


def format_stats(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, count and sum of views for shorts and long-form; 0 when a side is empty."""
    return profile(videos, video_totals(daily), ["short"], by).groupBy(*by).agg(
        level_value("short", 1, "mean_views").alias("mean_shorts"),
        level_value("short", 0, "mean_views").alias("mean_longform"),
        level_value("short", 1, "videos").alias("total_shorts"),
        level_value("short", 0, "videos").alias("total_longform"),
        level_value("short", 1, "views").alias("shorts_total_views"),
        level_value("short", 0, "views").alias("longform_total_views"),
    )


def yes_no_means(
    videos: DataFrame, daily: DataFrame, flag: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean views with and without a title flag; a missing side is 0."""
    return profile(videos, video_totals(daily), [flag], by).groupBy(*by).agg(
        level_value(flag, 1, "mean_views").alias("mean_with"),
        level_value(flag, 0, "mean_views").alias("mean_without"),
    )


def average_title_length(
    videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    everything = profile(videos, video_totals(daily), ["all"], by)
    mean = figures.ratio(F.sum("title_chars"), F.sum("titled"))
    return everything.groupBy(*by).agg(F.bround(mean, 1).alias("avg_title_length"))


def traffic_totals(
    traffic: DataFrame, videos: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Views per source. Grouping columns come from the videos, or are there already."""
    rows = with_group_columns(traffic, videos, by) if by and videos is not None else traffic
    return rows.groupBy(*by, "traffic_source_type").agg(F.sum("views").alias("total_views"))


def traffic_shares(
    traffic: DataFrame, videos: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Views per source and percent of the group's views, one decimal, ties to even."""
    totals = traffic_totals(traffic, videos, by)
    grand = totals.groupBy(*by).agg(F.sum("total_views").alias("_grand"))
    share = figures.ratio(F.col("total_views"), F.col("_grand")) * 100
    return beside(totals, [grand], by).select(
        *by, "traffic_source_type", "total_views", F.bround(share, 1).alias("percentage")
    )


def first_week_views(videos: DataFrame, daily: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Views up to seven days after publication, and in total, for videos with views.

    ``carried`` columns of the videos come along, so no second join is needed for them.

    Days before publication count too. (video, date) is the fact's key, so a video
    brings one row per calendar day to the join and cannot outgrow a task. The publish
    time joins the grouping key, as it depends on the video; the aggregate then runs
    on the join's own partitioning without another shuffle.
    """
    early = clock.days_after(F.col("date"), F.col("published_at")) <= FIRST_WEEK_DAYS
    return (
        daily.select("video_id", "date", "views")
        .join(videos.select("video_id", "published_at", *carried), "video_id")
        .groupBy("video_id", "published_at", *carried)
        .agg(
            F.sum(F.when(early, F.col("views")).otherwise(0)).alias("views_7d"),
            F.sum("views").alias("total_views"),
        )
        .filter(F.col("total_views") > 0)
        .select("video_id", *carried, "views_7d", "total_views")
    )


def final_days(as_of: dt.date, days: int = SERIES_DAYS) -> tuple[dt.date, dt.date]:
    """First and last day of the n days up to the last final one."""
    end = as_of - dt.timedelta(days=SOURCE_DELAY_DAYS)
    return end - dt.timedelta(days=days), end


def last_n_days(daily: DataFrame, as_of: dt.date, days: int = SERIES_DAYS) -> DataFrame:
    """Rows of the n days up to the last final day, both ends included."""
    start, end = final_days(as_of, days)
    return daily.filter(F.col("date").between(F.lit(start), F.lit(end)))


def channel_daily(
    daily: DataFrame,
    as_of: dt.date,
    days: int = SERIES_DAYS,
    videos: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per-day series: additive figures summed, averages weighted by views."""
    rows = last_n_days(daily, as_of, days)
    if by:
        rows = with_group_columns(rows, videos, by)

    def weighted(name: str) -> Column:
        total = F.sum(F.col(name).cast("double") * F.col("views"))
        return (total / F.nullif(F.sum("views"), F.lit(0).cast("bigint")).cast("double")).alias(name)

    return rows.groupBy(*by, "date").agg(
        F.sum("views").alias("views"),
        F.sum("estimated_minutes_watched").alias("estimated_minutes_watched"),
        weighted("average_view_duration"),
        weighted("average_view_percentage"),
        F.sum("subscribers_gained").alias("subscribers_gained"),
        F.sum("subscribers_lost").alias("subscribers_lost"),
    )


def one_video(rows: DataFrame, video_id: str) -> DataFrame:
    """Rows of one video; on stored tables the filter reaches the scan."""
    return rows.filter(F.col("video_id") == video_id)


def video_daily(daily: DataFrame, video_id: str, as_of: dt.date, days: int = SERIES_DAYS):
    """One video's daily series in date order."""
    return (
        last_n_days(one_video(daily, video_id), as_of, days)
        .select(
            "date",
            "views",
            "estimated_minutes_watched",
            "average_view_duration",
            "average_view_percentage",
        )
        .orderBy("date")
    )


def video_traffic(traffic: DataFrame, video_id: str) -> DataFrame:
    """One video's sources, most views first."""
    return (
        one_video(traffic, video_id)
        .select("traffic_source_type", "views", "estimated_minutes_watched")
        .orderBy(F.desc("views"), "traffic_source_type")
    )


def active_days(daily: DataFrame) -> DataFrame:
    """Drop days without views; a missing figure counts as none."""
    return daily.filter(F.coalesce(F.col("views"), F.lit(0)) != 0)


