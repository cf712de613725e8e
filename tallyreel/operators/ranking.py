"""Top-n lists."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreel.operators.grouping import top_n
from tallyreel.operators.totals import (
    mean_views_by,
    traffic_shares,
    video_totals,
    videos_with_totals,
)


def top_hours(videos: DataFrame, daily: DataFrame, n: int = 3, by: Sequence[str] = ()):
    """Hours with the highest mean views; equal means keep the earlier hour."""
    means = mean_views_by(videos, daily, "hour", by).withColumnRenamed("level", "hour")
    best = top_n(means, [F.desc("mean_views"), F.asc("hour")], n, by)
    return best.select(*by, "hour", "mean_views")


def top_sources(
    traffic: DataFrame, n: int, videos: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Sources with the most views and their share of all views."""
    order = [F.desc("total_views"), F.asc("traffic_source_type")]
    return top_n(traffic_shares(traffic, videos, by), order, n, by)


def top_videos(
    videos: DataFrame, daily: DataFrame, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """Most viewed videos with their titles."""
    ranked = videos_with_totals(videos, video_totals(daily), ["title"], by)
    order = [F.desc("total_views"), F.asc("video_id")]
    return top_n(ranked.select(*by, "video_id", "title", "total_views"), order, n, by)


def latest_videos(videos: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Newest videos by publish time."""
    rows = videos.select(*by, "video_id", "title", "published_at")
    return top_n(rows, [F.desc("published_at"), F.asc("video_id")], n, by)
