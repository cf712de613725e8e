"""Key upserts and the fetch plan.

An upsert is a union followed by "latest per key". The latest row is a maximum
over a struct, which Spark combines before the shuffle, so a key with very many
versions sends one row per task. Ties on time fall to the payload, which makes
the answer independent of the order in which batches arrive.
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreel.functions import clock
from tallyreel.operators.totals import SOURCE_DELAY_DAYS


def latest_by_key(rows: DataFrame, keys: Sequence[str], newest_by: str) -> DataFrame:
    """One row per key: the one with the greatest ``newest_by``."""
    payload = [c for c in rows.columns if c not in keys and c != newest_by]
    latest = F.max(F.struct(newest_by, *payload)).alias("_latest")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_latest.*").select(*rows.columns)


def upsert(
    stored: DataFrame | None, incoming: DataFrame, keys: Sequence[str], newest_by: str = "fetched_at"
) -> DataFrame:
    """Stored rows with incoming rows replacing those of the same key."""
    rows = incoming if stored is None else stored.unionByName(incoming.select(*stored.columns))
    return latest_by_key(rows, keys, newest_by)


def changed_rows(
    stored: DataFrame | None, incoming: DataFrame, keys: Sequence[str], newest_by: str = "fetched_at"
) -> tuple[DataFrame, DataFrame]:
    """Rows of the incoming keys as they were and as an upsert leaves them.

    Of the stored rows only those of incoming keys are kept; on a table stored by day, the
    days of the incoming rows reach the scan as a filter if the caller sets one.
    """
    if stored is None:
        return incoming.limit(0), latest_by_key(incoming, keys, newest_by)
    before = stored.join(incoming.select(*keys).distinct(), list(keys), "left_semi").select(*stored.columns)
    return before, upsert(before, incoming, keys, newest_by)


# A video keeps these from its first load; everything else follows the latest load.
KEPT_FROM_FIRST = ["channel_id", "published_at"]


def upsert_videos(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Insert new videos; refresh known ones but keep channel, publish and creation time.

    Incoming rows carry their load time in both created_at and updated_at.
    """
    rows = incoming if stored is None else stored.unionByName(incoming.select(*stored.columns))
    fixed = {"video_id", "created_at", "updated_at", *KEPT_FROM_FIRST}
    payload = [c for c in rows.columns if c not in fixed]
    merged = rows.groupBy("video_id").agg(
        F.min(F.struct("created_at", *KEPT_FROM_FIRST)).alias("_first"),
        F.max(F.struct("updated_at", *payload)).alias("_latest"),
    )
    return merged.select("video_id", "_first.*", "_latest.*").select(*rows.columns)


def fetch_plan(videos: DataFrame, as_of: dt.date) -> DataFrame:
    """Which days to pull per video: publish day to the last final day, if any."""
    end = F.date_sub(F.lit(as_of), SOURCE_DELAY_DAYS)
    return videos.select(
        "video_id",
        clock.day_of(F.col("published_at")).alias("start_date"),
        end.alias("end_date"),
    ).filter(F.col("start_date") <= F.col("end_date"))
