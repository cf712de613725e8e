"""Retention per video, its baseline, and the videos under it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.functions import exact, figures
from tallyreel.operators.grouping import attach, beside, top_n, with_group_columns
from tallyreel.operators.totals import video_facts
from tallyreel.sources.store import settle

# Videos at or under this many views are left out of the engagement figures.
MIN_VIEWS = 100
WEAK_VIDEOS = 5
SHOWN_TITLE_CHARS = 60


def watched_days(daily: DataFrame) -> DataFrame:
    """Days with a retention figure above zero."""
    return daily.filter(F.col("average_view_percentage") > 0)


def engaged_videos(
    videos: DataFrame, facts: DataFrame, by: Sequence[str] = (), min_views: int = MIN_VIEWS
) -> DataFrame:
    """Retention, watched views and net subscribers of videos above the view limit."""
    above = facts.filter(F.col("watched_views") > min_views).select(
        "video_id", "avg_retention", F.col("watched_views").alias("total_views"), "net_subs"
    )
    return with_group_columns(above, videos, by, ["title"])


def engaged_of(described: DataFrame, by: Sequence[str] = (), min_views: int = MIN_VIEWS) -> DataFrame:
    """The same from rows that carry facts, groups and titles."""
    return described.filter(F.col("watched_views") > min_views).select(
        "video_id", "avg_retention", F.col("watched_views").alias("total_views"), "net_subs", *by, "title"
    )


def engagement_by_video(
    videos: DataFrame, daily: DataFrame, by: Sequence[str] = (), min_views: int = MIN_VIEWS
) -> DataFrame:
    """The same from the fact, of which only watched days are read."""
    return engaged_videos(videos, video_facts(watched_days(daily)), by, min_views)


def settled_engagement(
    videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Engagement written out once, for comparisons that read it more than once.

    One row per video is far smaller than the fact, which is then scanned once
    instead of once for the means and again for the rows compared with them.
    """
    return settle(engagement_by_video(videos, daily, by), "engaged")


def baseline(engaged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over videos of their retention and of their views."""
    return engaged.groupBy(*by).agg(
        exact.mean("avg_retention").alias("baseline_retention"),
        figures.ratio(F.sum("total_views"), F.count("total_views")).alias("baseline_views"),
    )


def under_baseline() -> Column:
    return F.col("avg_retention") < F.col("baseline_retention")


def below_baseline(engaged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Videos strictly under their group's mean retention.

    Both sides are means that were rounded once, so they compare alike whatever the
    partitioning, and no difference is too small to count.
    """
    compared = attach(engaged, baseline(engaged, by), by, ["video_id"])
    return compared.filter(under_baseline())


def weak_videos(
    engaged: DataFrame, n: int = WEAK_VIDEOS, by: Sequence[str] = ()
) -> DataFrame:
    """The n videos with the lowest retention among those under the mean.

    The videos under the mean come first in retention order, so the n lowest of all
    are taken before the comparison, which then sees n rows per group.
    """
    lowest = top_n(engaged, [F.asc("avg_retention"), F.asc("video_id")], n, by)
    worst = beside(lowest, [baseline(engaged, by)], by).filter(under_baseline())
    return worst.select(
        *by,
        "video_id",
        F.substring("title", 1, SHOWN_TITLE_CHARS).alias("title"),
        F.bround("avg_retention", 1).alias("avg_retention"),
        figures.whole(F.col("total_views")).alias("total_views"),
        figures.whole(F.col("net_subs")).alias("net_subs"),
        F.bround(F.col("baseline_retention") - F.col("avg_retention"), 1).alias("below_avg_by"),
        F.col("avg_retention").alias("_order"),
    )


def weak_summary(engaged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded baseline per group, and how many videos are under it before any top-n."""
    compared = attach(engaged, baseline(engaged, by), by, ["video_id"])
    return compared.groupBy(*by).agg(
        F.bround(F.max("baseline_retention"), 1).alias("channel_avg_retention"),
        figures.whole(F.max("baseline_views")).alias("channel_avg_views"),
        F.count_if(under_baseline()).alias("total_weak_count"),
    )
