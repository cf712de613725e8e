"""Star tables and landed pages derived from general event and document tables.

A video stands for a user: it is published at the time of the user's strongest
event, and its heading and body are the document of the same number. The daily
fact and the traffic fact are the user's events by day and by type.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel.functions import titles


# Columns read from each table. A fixed schema saves Spark the job that infers one.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint",
    "orders": "o_custkey bigint, o_totalprice double",
    "part": "p_partkey bigint, p_name string, p_type string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _video_id() -> Column:
    return F.concat(F.lit("v"), F.col("user_id").cast("string"))


def heading(text: Column) -> Column:
    """A document's first line, whole."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def videos(spark: SparkSession, folder: str) -> DataFrame:
    # A maximum over a struct instead of a ranking window: partial results leave each
    # task, so a user with a large share of the events does not fill one task.
    strongest = F.max(F.struct("value", (-F.col("event_id")).alias("e"), "ts"))
    published = (
        table(spark, folder, "events").groupBy("user_id").agg(strongest["ts"].alias("published_at"))
    )
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("user_id"),
        F.concat(F.lit("c_"), F.col("lang")).alias("channel_id"),
        heading(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        (F.col("n_chars") % 180).alias("duration_seconds"),
        F.col("source").alias("category_id"),
    )
    return published.join(documents, "user_id").select(
        _video_id().alias("video_id"),
        "channel_id",
        "title",
        "description",
        "published_at",
        "duration_seconds",
        "category_id",
        F.when(F.col("duration_seconds") <= 60, 1).otherwise(0).alias("is_short"),
    )


def _views() -> Column:
    """Event value spread over four orders of magnitude, so every view class occurs."""
    scaled = F.col("value") * F.pow(F.lit(10), F.col("user_id") % 4)
    return F.sum(F.floor(scaled).cast("bigint"))


def _minutes() -> Column:
    # Whole cents, so the sum does not depend on the order of the rows.
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return F.floor(cents / F.lit(100.0)).cast("bigint")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    grouped = (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("date"))
        .agg(
            _views().alias("views"),
            _minutes().alias("estimated_minutes_watched"),
            (F.lit(100.0) * _count(kind != "error") / F.count("*")).alias("average_view_percentage"),
            _count(kind == "signup").alias("subscribers_gained"),
            _count(kind == "error").alias("subscribers_lost"),
        )
    )
    per_view = F.floor(F.col("estimated_minutes_watched") * 60.0 / F.col("views")).cast("bigint")
    return grouped.select(
        _video_id().alias("video_id"),
        "date",
        "views",
        "estimated_minutes_watched",
        F.when(F.col("views") > 0, per_view).otherwise(0).alias("average_view_duration"),
        "average_view_percentage",
        "subscribers_gained",
        "subscribers_lost",
    )


def traffic_sources(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(_views().alias("views"), _minutes().alias("estimated_minutes_watched"))
        .select(
            _video_id().alias("video_id"),
            F.upper("event_type").alias("traffic_source_type"),
            "views",
            "estimated_minutes_watched",
        )
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not published as videos yet."""
    published = table(spark, folder, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return (
        table(spark, folder, "documents")
        .join(published, "doc_id", "left_anti")
        .select(
            "doc_id",
            F.concat(F.lit("c_"), F.col("lang")).alias("channel_id"),
            heading(F.col("text")).alias("title"),
        )
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored replies: an event's properties in the shapes replies come in.

    Purchases are plain objects, views fenced ones, clicks carry a leading word,
    signups are lists and errors are cut off.
    """
    props = F.col("props")
    shaped = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), props, F.lit("\n```\n")))
        .when(F.col("event_type") == "click", F.concat(F.lit("  JSON "), props))
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .when(F.col("event_type") == "error", F.concat(props, F.lit(" and {")))
        .otherwise(props)
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("cache_key"),
        shaped.alias("response"),
        F.col("ts").alias("created_at"),
    )


# Landed pages: the same tables in the shape the report files have.


def _iso(ts: Column) -> Column:
    """UTC wall clock as ISO 8601 text with microseconds and Z."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def id_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page of one id per video."""
    rows = videos(spark, folder).select("video_id")
    item = F.struct(F.struct(F.col("video_id").alias("videoId")).alias("contentDetails"))
    return rows.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))


def metadata_pages(
    spark: SparkSession, folder: str, fetched_at: str = "2024-02-01T00:00:00Z"
) -> DataFrame:
    """One metadata page per video. Sources with a one-digit number have no category; null keys are absent."""
    v = videos(spark, folder)
    item = F.struct(
        F.col("video_id").alias("id"),
        F.struct(
            F.col("channel_id").alias("channelId"),
            "title",
            "description",
            _iso(F.col("published_at")).alias("publishedAt"),
            F.when(titles.title_length(F.col("category_id")) > 4, F.col("category_id")).alias(
                "categoryId"
            ),
        ).alias("snippet"),
        F.struct(
            F.concat(
                F.lit("PT"),
                F.floor(F.col("duration_seconds") / 60).cast("string"),
                F.lit("M"),
                F.pmod("duration_seconds", F.lit(60)).cast("string"),
                F.lit("S"),
            ).alias("duration")
        ).alias("contentDetails"),
    )
    page = F.struct(F.lit(fetched_at).alias("fetched_at"), F.array(item).alias("items"))
    return v.select(F.to_json(page).alias("value"))


def _page(fetched_at: str, headers: list[str], cells: list[Column], sort_by: Column) -> Column:
    """Report page text: cells keep their JSON types, which differ within a row."""
    names = ",".join(f'{{"name":"{h}"}}' for h in headers)
    row = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct(sort_by.alias("o"), row.alias("r")))), lambda x: x["r"]
    )
    return F.concat(
        F.lit('{"video_id":"'),
        F.col("video_id"),
        F.lit(f'","fetched_at":"{fetched_at}","columnHeaders":[{names}],"rows":['),
        F.array_join(rows, ","),
        F.lit("]}"),
    ).alias("value")


def daily_pages(
    spark: SparkSession, folder: str, fetched_at: str = "2024-02-01T00:00:00Z", views_share: int = 1
) -> DataFrame:
    """One daily report per video, at most one row per calendar day in it.

    ``views_share`` divides the views, for an earlier and lower state of the figures.
    """
    columns = {
        "views": F.floor(F.col("views") / views_share).cast("string"),
        "day": F.concat(F.lit('"'), F.col("date").cast("string"), F.lit('"')),
        "estimatedMinutesWatched": F.col("estimated_minutes_watched").cast("string"),
        "averageViewPercentage": F.col("average_view_percentage").cast("string"),
        "subscribersLost": F.col("subscribers_lost").cast("string"),
        "subscribersGained": F.col("subscribers_gained").cast("string"),
    }
    longer = {**columns, "averageViewDuration": F.col("average_view_duration").cast("string")}
    with_it, without = (_page(fetched_at, list(c), list(c.values()), F.col("date")) for c in (longer, columns))
    pages = daily_metrics(spark, folder).groupBy("video_id").agg(with_it.alias("long"), without.alias("short"))
    return pages.select(F.when(has_duration(), F.col("long")).otherwise(F.col("short")).alias("value"))


def has_duration() -> Column:
    """Videos with an even number report the mean view duration; the other half's reports lack it."""
    return F.pmod(F.substring("video_id", 2, 20).cast("bigint"), F.lit(2)) == 0


def traffic_pages(
    spark: SparkSession, folder: str, fetched_at: str = "2024-02-01T00:00:00Z"
) -> DataFrame:
    """One traffic report per video, at most one row per source type in it."""
    columns = {
        "insightTrafficSourceType": F.concat(
            F.lit('"'), F.col("traffic_source_type"), F.lit('"')
        ),
        "views": F.col("views").cast("string"),
        "estimatedMinutesWatched": F.col("estimated_minutes_watched").cast("string"),
    }
    page = _page(fetched_at, list(columns), list(columns.values()), -F.col("views"))
    return traffic_sources(spark, folder).groupBy("video_id").agg(page).select("value")


def channel_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page per channel with its view and video counts; subscribers are not known."""
    totals = (
        traffic_sources(spark, folder)
        .groupBy("video_id")
        .agg(F.sum("views").alias("views"))
        .join(videos(spark, folder).select("video_id", "channel_id"), "video_id")
        .groupBy("channel_id")
        .agg(F.sum("views").alias("views"), F.count("*").alias("videos"))
    )
    item = F.struct(
        F.col("channel_id").alias("id"),
        F.struct(F.upper("channel_id").alias("title")).alias("snippet"),
        F.struct(
            F.col("views").cast("string").alias("viewCount"),
            F.col("videos").cast("string").alias("videoCount"),
        ).alias("statistics"),
    )
    return totals.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
