"""Landed report files and their flattening into table rows.

A landed file holds one JSON page per line. Report cells mix text and numbers, so
they are read as text and cast per column.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.functions import clock, figures

DESCRIPTION_CHARS = 1_000
NOT_AVAILABLE = "N/A"

ID_PAGE = "items array<struct<contentDetails:struct<videoId:string>>>, nextPageToken string"
VIDEO_PAGE = """
    fetched_at string,
    items array<struct<
        id:string,
        snippet:struct<
            channelId:string, title:string, description:string, publishedAt:string,
            categoryId:string, thumbnails:struct<high:struct<url:string>>>,
        contentDetails:struct<duration:string>>>
"""
REPORT_PAGE = """
    video_id string,
    fetched_at string,
    columnHeaders array<struct<name:string>>,
    rows array<array<string>>
"""
CHANNEL_PAGE = """
    items array<struct<
        id:string,
        snippet:struct<title:string>,
        statistics:struct<subscriberCount:string, viewCount:string, videoCount:string>>>
"""

# Report column names and the table columns they fill.
DAILY_COLUMNS = {
    "views": ("views", "bigint"),
    "estimatedMinutesWatched": ("estimated_minutes_watched", "bigint"),
    "averageViewDuration": ("average_view_duration", "bigint"),
    "averageViewPercentage": ("average_view_percentage", "double"),
    "subscribersGained": ("subscribers_gained", "bigint"),
    "subscribersLost": ("subscribers_lost", "bigint"),
}
TRAFFIC_COLUMNS = {
    "views": ("views", "bigint"),
    "estimatedMinutesWatched": ("estimated_minutes_watched", "bigint"),
}


# A page that can't be read, with its text.
UNREADABLE = "_unreadable"


def read_landed(
    spark: SparkSession, path: str, page: str, one_page_per_file: bool = False
) -> DataFrame:
    """Pages from files with a page per line, or with one page over many lines."""
    return parse_landed(spark.read.text(path, wholetext=one_page_per_file), page)


def parse_landed(lines: DataFrame, page: str, column: str = "value") -> DataFrame:
    """Pages from JSON text; one that is no such page has only its text, as unreadable."""
    schema = T.StructType([*T.StructType.fromDDL(page).fields, T.StructField(UNREADABLE, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}
    filled = lines.filter(F.trim(column) != "")
    return filled.select(F.from_json(column, schema, options).alias("p")).select("p.*")


def _readable(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col(UNREADABLE).isNull())


def _rejects(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Unreadable pages, and rows that carry a reason: (reason, raw)."""
    unread = pages.filter(F.col(UNREADABLE).isNotNull())
    return unread.select(F.lit("page cannot be read").alias("reason"), F.col(UNREADABLE).alias("raw")).union(
        rows.filter(F.col("reason").isNotNull()).select("reason", "raw")
    )


def _missing(**keys: Column) -> Column:
    """Names the first key that is null; null if none is."""
    return F.coalesce(*[F.when(c.isNull(), F.lit(f"no {n.replace('_', ' ')}")) for n, c in keys.items()])


def video_ids(pages: DataFrame) -> DataFrame:
    """Ids over all pages, as often as they are listed. Pages without items give none."""
    return (
        _readable(pages).select(F.explode("items").alias("i"))
        .select(F.col("i.contentDetails.videoId").alias("video_id"))
        .filter(F.col("video_id").isNotNull())
    )


def _metadata_rows(pages: DataFrame) -> DataFrame:
    item = _readable(pages).select("fetched_at", F.explode("items").alias("i"))
    seconds = figures.duration_seconds(F.col("i.contentDetails.duration"))
    loaded = clock.utc_wall_clock(F.col("fetched_at"))
    published = clock.utc_wall_clock(F.col("i.snippet.publishedAt"))
    return item.select(
        F.col("i.id").alias("video_id"),
        F.col("i.snippet.channelId").alias("channel_id"),
        F.col("i.snippet.title").alias("title"),
        F.substring(
            F.coalesce("i.snippet.description", F.lit("")), 1, DESCRIPTION_CHARS
        ).alias("description"),
        published.alias("published_at"),
        seconds.alias("duration_seconds"),
        F.col("i.snippet.categoryId").alias("category_id"),
        F.coalesce("i.snippet.thumbnails.high.url", F.lit("")).alias("thumbnail_url"),
        figures.short_flag(seconds).alias("is_short"),
        loaded.alias("created_at"),
        loaded.alias("updated_at"),
        _missing(
            video_id=F.col("i.id"), channel_id=F.col("i.snippet.channelId"), publish_time=published
        ).alias("reason"),
        F.to_json("i").alias("raw"),
    )


def video_metadata(pages: DataFrame) -> DataFrame:
    """Video rows from metadata pages, with load times from the page. Rows without keys are rejects."""
    return _metadata_rows(pages).filter(F.col("reason").isNull()).drop("reason", "raw")


def metadata_rejects(pages: DataFrame) -> DataFrame:
    return _rejects(pages, _metadata_rows(pages))


def _cell(header: str) -> tuple[Column, Column]:
    """Whether a row has a cell under the header, and the cell's text."""
    position = F.array_position("names", header)
    present = (position > 0) & (position <= F.size("row"))
    return present, F.get("row", (position - 1).cast("int"))


def _number(header: str, kind: str) -> Column:
    """The cell as a number; 0 when the report has no such cell."""
    present, text = _cell(header)
    if kind == "bigint":
        value = text.try_cast("decimal(38,6)").cast("bigint")
    else:
        value = text.try_cast(kind)
    return F.when(present, value).otherwise(F.lit(0)).cast(kind)


def _report_rows(pages: DataFrame) -> DataFrame:
    return _readable(pages).select(
        "video_id",
        clock.utc_wall_clock(F.col("fetched_at")).alias("fetched_at"),
        F.transform("columnHeaders", lambda h: h["name"]).alias("names"),
        F.explode("rows").alias("row"),
    )


def _fact_rows(pages: DataFrame, key: str, value: Column, columns: dict, what: str) -> DataFrame:
    numbers = [_number(h, kind).alias(name) for h, (name, kind) in columns.items()]
    return _report_rows(pages).select(
        "video_id",
        value.alias(key),
        *numbers,
        "fetched_at",
        _missing(**{"video_id": F.col("video_id"), what: value}).alias("reason"),
        F.to_json(F.struct("video_id", "names", "row")).alias("raw"),
    )


def _daily_rows(pages: DataFrame) -> DataFrame:
    return _fact_rows(pages, "date", F.try_to_date(_cell("day")[1]), DAILY_COLUMNS, "day")


def daily_report(pages: DataFrame) -> DataFrame:
    """Daily metric rows. Days with no views are left out; rows without video or day are rejects."""
    rows = _daily_rows(pages).filter(F.col("reason").isNull()).drop("reason", "raw")
    return rows.filter(~F.col("views").eqNullSafe(F.lit(0)))


def daily_rejects(pages: DataFrame) -> DataFrame:
    return _rejects(pages, _daily_rows(pages))


def _traffic_rows(pages: DataFrame) -> DataFrame:
    kind = _cell("insightTrafficSourceType")[1]
    return _fact_rows(pages, "traffic_source_type", kind, TRAFFIC_COLUMNS, "source_type")


def traffic_report(pages: DataFrame) -> DataFrame:
    """Traffic rows. Sources with no views are kept; rows without video or source type are rejects."""
    return _traffic_rows(pages).filter(F.col("reason").isNull()).drop("reason", "raw")


def traffic_rejects(pages: DataFrame) -> DataFrame:
    return _rejects(pages, _traffic_rows(pages))


def channel_info(pages: DataFrame) -> DataFrame:
    """Title, id and counts of each page's channel; absent counts read N/A."""
    channel = _readable(pages).select(F.get("items", F.lit(0)).alias("c")).filter(F.col("c").isNotNull())

    def count(name):
        return F.coalesce(F.col(f"c.statistics.{name}"), F.lit(NOT_AVAILABLE))

    return channel.select(
        F.col("c.snippet.title").alias("title"),
        F.col("c.id").alias("channel_id"),
        count("subscriberCount").alias("subscribers"),
        count("viewCount").alias("views"),
        count("videoCount").alias("videos"),
    )
