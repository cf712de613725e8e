"""Every registered query: (spark, folder of Parquet tables) -> DataFrame.

Each reads whole tables. Parameters (days, ids, list lengths) are the reports' own.
"""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel.functions import clock, figures, titles
from tallyreel.operators import audits, engagement, ranking, totals, upserts
from tallyreel.plans import charts, context, forecast, replies, reports, slots
from tallyreel.plans.audited import KeptAudits
from tallyreel.plans.kept import Changes, KeptReports
from tallyreel.schemas import DAILY_METRICS, DAY_NAMES, FEATURES, KEYS, TRAFFIC_SOURCES, VIDEOS, conform
from tallyreel.sources import binding, landing
from tallyreel.sources.store import fresh_folder, settle
from tallyreel.sources.versions import read_days, read_table, upsert_stored, write_table
from tallyreel.streaming import landing_stream

AS_OF = dt.date(2024, 1, 30)
SERIES_AS_OF = dt.date(2024, 2, 15)
REPLIES_AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)
ONE_VIDEO = "v7"
EARLIER_LOAD = "2024-02-01T00:00:00Z"
LATER_LOAD = "2024-02-02T00:00:00Z"
HALFWAY = dt.datetime(2024, 1, 16)
CHANNEL = ["channel_id"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name):
    def register(function):
        QUERIES[name] = function
        return function

    return register


def _vd(spark, folder):
    return binding.videos(spark, folder), binding.daily_metrics(spark, folder)


def _star(spark, folder):
    return (*_vd(spark, folder), binding.traffic_sources(spark, folder))


def _listed(column):
    """A list as text, so that every engine compares it alike."""
    return F.array_join(F.col(column).cast("array<string>"), "|").alias(column)


# Tables, landing and quality ------------------------------------------------


@query("scan_videos")
def scan_videos(spark, folder):
    return binding.videos(spark, folder).select(
        "video_id",
        "channel_id",
        "title",
        "published_at",
        "duration_seconds",
        F.col("is_short").cast("bigint").alias("is_short"),
    )


@query("scan_daily_metrics")
def scan_daily_metrics(spark, folder):
    daily = binding.daily_metrics(spark, folder)
    return daily.withColumn("average_view_percentage", F.bround("average_view_percentage", 6))


@query("scan_traffic_sources")
def scan_traffic_sources(spark, folder):
    return binding.traffic_sources(spark, folder)


@query("stored_daily_metrics")
def stored_daily_metrics(spark, folder):
    """Write the fact by month, refresh it with a later load, read it back."""
    daily = binding.daily_metrics(spark, folder)
    first = conform(
        daily.withColumn("views", F.lit(0).cast("bigint")),
        DAILY_METRICS,
        F.lit("2024-02-01 00:00:00"),
    )
    second = conform(daily, DAILY_METRICS, F.lit("2024-02-02 00:00:00"))
    path = fresh_folder(spark, "daily")
    write_table(first, path, "daily_metrics")
    upsert_stored(spark, path, "daily_metrics", second)
    return read_table(spark, path, "daily_metrics").select("video_id", "date", "views")


@query("stored_videos")
def stored_videos(spark, folder):
    """Write the first half of the loads of videos, merge the second, read the table back."""
    loads = conform(_video_loads(spark, folder), VIDEOS, F.lit(None))
    half = F.lit(HALFWAY).cast("timestamp_ntz")
    path = fresh_folder(spark, "videos")
    write_table(upserts.upsert_videos(None, loads.filter(F.col("created_at") < half)), path, "videos")
    upsert_stored(spark, path, "videos", loads.filter(F.col("created_at") >= half))
    return read_table(spark, path, "videos").select(*VIDEO_LOAD_COLUMNS)


@query("stored_traffic_sources")
def stored_traffic_sources(spark, folder):
    """Write the traffic with no views, refresh it with a later load, read it back."""
    traffic = binding.traffic_sources(spark, folder)
    early = traffic.withColumn("views", F.lit(0).cast("bigint"))
    path = fresh_folder(spark, "traffic")
    write_table(conform(early, TRAFFIC_SOURCES, F.lit("2024-02-01 00:00:00")), path, "traffic_sources")
    upsert_stored(
        spark, path, "traffic_sources", conform(traffic, TRAFFIC_SOURCES, F.lit("2024-02-02 00:00:00"))
    )
    return read_table(spark, path, "traffic_sources").drop("fetched_at")


@query("landing_rejects")
def landing_rejects(spark, folder):
    """Landed files in which a fifth of the pages are cut off and a fifth have a bad day."""
    number = F.pmod(F.regexp_extract("value", r'"video_id":"v(\d+)"', 1).cast("bigint"), F.lit(5))
    spoilt = (
        F.when(number == 0, F.expr("substring(value, 1, length(value) - 7)"))
        .when(number == 1, F.replace("value", F.lit('"2024-01-05"'), F.lit('"some day"')))
        .otherwise(F.col("value"))
    )
    landed = f"{fresh_folder(spark, 'rejects')}/landed"
    binding.daily_pages(spark, folder).select(spoilt.alias("value")).write.text(landed)
    pages = landing.read_landed(spark, landed, landing.REPORT_PAGE)
    kept = landing.daily_report(pages).agg(F.count("*").alias("kept"))
    return landing.daily_rejects(pages).agg(
        F.count_if(F.col("reason") == "page cannot be read").alias("unreadable"),
        F.count_if(F.col("reason") == "no day").alias("without_day"),
        F.count_if(F.col("raw").isNull()).alias("without_text"),
    ).select("*", kept.scalar().alias("kept"))


@query("stored_last_n_days")
def stored_last_n_days(spark, folder):
    """Write the fact by month and read back the days of a series."""
    daily = binding.daily_metrics(spark, folder)
    path = fresh_folder(spark, "daily")
    write_table(conform(daily, DAILY_METRICS, F.lit("2024-02-01 00:00:00")), path, "daily_metrics")
    rows = read_days(spark, path, *totals.final_days(SERIES_AS_OF))
    return rows.select("video_id", "date", "views")


@query("landing_video_ids")
def landing_video_ids(spark, folder):
    return landing.video_ids(landing.parse_landed(binding.id_pages(spark, folder), landing.ID_PAGE))


def _metadata(spark, folder):
    pages = landing.parse_landed(binding.metadata_pages(spark, folder), landing.VIDEO_PAGE)
    return landing.video_metadata(pages)


@query("landing_video_metadata")
def landing_video_metadata(spark, folder):
    return _metadata(spark, folder).select(
        "video_id",
        "channel_id",
        "title",
        "description",
        "published_at",
        "duration_seconds",
        "category_id",
        "thumbnail_url",
        F.col("is_short").cast("bigint").alias("is_short"),
    )


@query("landing_daily_report")
def landing_daily_report(spark, folder):
    pages = landing.parse_landed(binding.daily_pages(spark, folder), landing.REPORT_PAGE)
    rows = landing.daily_report(pages).drop("fetched_at")
    return rows.withColumn("average_view_percentage", F.bround("average_view_percentage", 6))


@query("landing_traffic_report")
def landing_traffic_report(spark, folder):
    pages = landing.parse_landed(binding.traffic_pages(spark, folder), landing.REPORT_PAGE)
    return landing.traffic_report(pages).drop("fetched_at")


@query("channel_info")
def channel_info(spark, folder):
    pages = landing.parse_landed(binding.channel_pages(spark, folder), landing.CHANNEL_PAGE)
    return landing.channel_info(pages)


def _loads(spark, folder):
    """Events as repeated loads of three tables' rows."""
    return binding.table(spark, folder, "events").select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"),
        "event_type",
        "props",
        "ts",
        F.floor("value").cast("bigint").alias("amount"),
    )


VIDEO_LOAD_COLUMNS = [
    "video_id", "channel_id", "title", "published_at", "duration_seconds", "created_at", "updated_at",
]


def _video_loads(spark, folder):
    return _loads(spark, folder).select(
        "video_id",
        F.col("event_type").alias("channel_id"),
        F.col("props").alias("title"),
        F.col("ts").alias("published_at"),
        F.col("amount").alias("duration_seconds"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


@query("upsert_videos")
def upsert_videos(spark, folder):
    loads = _video_loads(spark, folder)
    half = F.lit(HALFWAY).cast("timestamp_ntz")
    stored = upserts.upsert_videos(None, loads.filter(F.col("created_at") < half))
    return upserts.upsert_videos(stored, loads.filter(F.col("created_at") >= half))


def _upsert_fact(spark, folder, key):
    loads = _loads(spark, folder).select(
        "video_id", key.alias("key"), F.col("amount").alias("views"), F.col("ts").alias("fetched_at")
    )
    half = F.lit(HALFWAY).cast("timestamp_ntz")
    keys = ["video_id", "key"]
    stored = upserts.upsert(None, loads.filter(F.col("fetched_at") < half), keys)
    return upserts.upsert(stored, loads.filter(F.col("fetched_at") >= half), keys)


@query("upsert_daily_metrics")
def upsert_daily_metrics(spark, folder):
    return _upsert_fact(spark, folder, F.to_date("ts")).withColumnRenamed("key", "date")


@query("upsert_traffic_sources")
def upsert_traffic_sources(spark, folder):
    rows = _upsert_fact(spark, folder, F.upper("event_type"))
    return rows.withColumnRenamed("key", "traffic_source_type")


@query("audit_unique")
def audit_unique(spark, folder):
    """Repeated (video, day) keys among the loads, before any upsert."""
    loads = _loads(spark, folder).withColumn("date", F.to_date("ts"))
    return audits.repeated_keys(loads, KEYS["daily_metrics"])


@query("audit_not_null")
def audit_not_null(spark, folder):
    rows = _metadata(spark, folder)
    return audits.null_counts(rows, ["video_id", "channel_id", "title", "published_at", "category_id"])


@query("audit_daily_orphans")
def audit_daily_orphans(spark, folder):
    """Daily rows whose video is not among the labelled documents."""
    labelled = binding.table(spark, folder, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id")
    )
    facts = binding.daily_metrics(spark, folder)
    return audits.orphans(facts, labelled).select("video_id", "date", "views")


@query("audit_orphans")
def audit_orphans(spark, folder):
    """Traffic rows whose video is not among the labelled documents."""
    labelled = binding.table(spark, folder, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id")
    )
    facts = binding.traffic_sources(spark, folder)
    return audits.orphans(facts, labelled).select("video_id", "traffic_source_type", "views")


def _audited_loads(spark, name, loads, keys, known):
    """Audits after each of some appended loads; each reads the parts it touched.

    A load's rows carry their part, of which there are few: days, or kinds of sources.
    """
    root = fresh_folder(spark, f"audited-{name}")
    kept = KeptAudits(spark, f"{root}/audits", keys, ["video_id", "views"])
    for number, (rows, videos) in enumerate(zip(loads, known)):
        rows = settle(rows.select(*keys, "views", "part"), f"audited-{name}")
        rows.write.mode("append").partitionBy("part").parquet(f"{root}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{root}/rows")
        parts = [r["part"] for r in rows.select("part").distinct().collect()]
        added = videos.join(known[number - 1], "video_id", "left_anti") if number else None
        kept.apply(number, number - 1 if number else None, stored, parts, videos, added)
    return kept.summary(len(loads) - 1).select(F.lit(name).alias("fact"), "*")


@query("audit_kept_parts")
def audit_kept_parts(spark, folder):
    """Both facts audited after a second load that repeats three days and one kind of source."""
    labelled = binding.table(spark, folder, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id")
    ).distinct()
    published = binding.videos(spark, folder).filter(F.col("published_at") < F.lit(HALFWAY).cast("timestamp_ntz"))
    known = [labelled.join(published, "video_id", "left_semi"), labelled]

    daily = binding.daily_metrics(spark, folder).withColumn("part", F.col("date").cast("string"))
    half = F.lit(HALFWAY.date())
    days = [daily.filter(F.col("date") < half), daily.filter(F.col("date") >= F.date_sub(half, 3))]
    traffic = binding.traffic_sources(spark, folder).withColumn("part", F.lower("traffic_source_type"))
    late, again = F.col("part") == "purchase", F.col("part") == "signup"
    sources = [traffic.filter(~late), traffic.filter(late | again)]
    return _audited_loads(spark, "daily", days, KEYS["daily_metrics"], known).unionByName(
        _audited_loads(spark, "traffic", sources, KEYS["traffic_sources"], known)
    )


@query("fetch_plan")
def fetch_plan(spark, folder):
    return upserts.fetch_plan(binding.videos(spark, folder), AS_OF)


@query("stream_landing_upsert")
def stream_landing_upsert(spark, folder):
    """Two drops of report files, the second with final views, loaded as they arrive."""
    root = fresh_folder(spark, "stream")
    landed, sink, progress = f"{root}/landed", f"{root}/rows", f"{root}/progress"
    for load, share in [(EARLIER_LOAD, 2), (LATER_LOAD, 1)]:
        pages = binding.daily_pages(spark, folder, load, share)
        pages.write.mode("append").text(landed)
        landing_stream.load_new_files(spark, "daily_metrics", landed, sink, progress)
    rows = landing_stream.current(spark, "daily_metrics", sink).drop("fetched_at")
    return rows.withColumn("average_view_percentage", F.bround("average_view_percentage", 6))


# Filters and joins -----------------------------------------------------------


@query("filter_positive_retention")
def filter_positive_retention(spark, folder):
    rows = engagement.watched_days(binding.daily_metrics(spark, folder))
    return rows.select(
        "video_id", "date", "views", F.bround("average_view_percentage", 6).alias("retention")
    )


@query("filter_active_days")
def filter_active_days(spark, folder):
    return totals.active_days(binding.daily_metrics(spark, folder)).select("video_id", "date", "views")


def _engaged(spark, folder, by=()):
    return engagement.engagement_by_video(*_vd(spark, folder), by)


def _settled(spark, folder, by=()):
    return engagement.settled_engagement(*_vd(spark, folder), by)


def _below(spark, folder, by):
    rows = engagement.below_baseline(_settled(spark, folder, by), by)
    return rows.select(
        *by,
        "video_id",
        F.bround("avg_retention", 6).alias("avg_retention"),
        F.bround("baseline_retention", 6).alias("baseline_retention"),
    )


@query("filter_below_mean")
def filter_below_mean(spark, folder):
    return _below(spark, folder, [])


@query("filter_below_mean_by_channel")
def filter_below_mean_by_channel(spark, folder):
    return _below(spark, folder, CHANNEL)


@query("filter_complete_features")
def filter_complete_features(spark, folder):
    return forecast.training_rows(*_vd(spark, folder)).select("video_id", "views_7d", "total_views")


@query("filter_last_n_days")
def filter_last_n_days(spark, folder):
    rows = totals.last_n_days(binding.daily_metrics(spark, folder), SERIES_AS_OF)
    return rows.select("video_id", "date", "views")


@query("filter_one_video")
def filter_one_video(spark, folder):
    rows = totals.one_video(binding.daily_metrics(spark, folder), ONE_VIDEO)
    return rows.select("video_id", "date", "views")


@query("having_min_views")
def having_min_views(spark, folder):
    return _engaged(spark, folder).select("video_id", "total_views")


@query("having_positive_views")
def having_positive_views(spark, folder):
    return totals.first_week_views(*_vd(spark, folder)).select("video_id", "total_views")


@query("join_videos_totals")
def join_videos_totals(spark, folder):
    videos, daily = _vd(spark, folder)
    columns = ["channel_id", "title", "published_at"]
    return totals.videos_with_totals(videos, totals.video_totals(daily), columns).select(
        "video_id", *columns, "total_views"
    )


@query("join_daily_videos")
def join_daily_videos(spark, folder):
    videos, daily = _vd(spark, folder)
    return daily.select("video_id", "date", "views").join(
        videos.select("video_id", "channel_id", "published_at"), "video_id"
    )


@query("day_spine")
def day_spine(spark, folder):
    return totals.mean_views_by_weekday(*_vd(spark, folder))


@query("day_spine_by_channel")
def day_spine_by_channel(spark, folder):
    return totals.mean_views_by_weekday(*_vd(spark, folder), CHANNEL)


# Aggregations ----------------------------------------------------------------


@query("video_totals")
def video_totals(spark, folder):
    return totals.video_totals(binding.daily_metrics(spark, folder))


@query("avg_views_by_hour")
def avg_views_by_hour(spark, folder):
    means = totals.mean_views_by(*_vd(spark, folder), "hour")
    return means.select(F.col("level").alias("hour"), "mean_views")


@query("avg_views_by_day")
def avg_views_by_day(spark, folder):
    return totals.mean_views_by_weekday(*_vd(spark, folder)).select("day", "mean_views")


@query("format_stats")
def format_stats(spark, folder):
    return totals.format_stats(*_vd(spark, folder))


@query("traffic_totals")
def traffic_totals(spark, folder):
    return totals.traffic_totals(binding.traffic_sources(spark, folder))


@query("traffic_share")
def traffic_share(spark, folder):
    return totals.traffic_shares(binding.traffic_sources(spark, folder))


@query("traffic_share_by_channel")
def traffic_share_by_channel(spark, folder):
    videos, _, traffic = _star(spark, folder)
    return totals.traffic_shares(traffic, videos, CHANNEL)


@query("engagement_by_video")
def engagement_by_video(spark, folder):
    return _engaged(spark, folder).select(
        "video_id",
        "title",
        F.bround("avg_retention", 6).alias("avg_retention"),
        "total_views",
        "net_subs",
    )


@query("channel_engagement_baseline")
def channel_engagement_baseline(spark, folder):
    return engagement.baseline(_engaged(spark, folder, CHANNEL), CHANNEL).select(
        "channel_id",
        F.bround("baseline_retention", 6).alias("baseline_retention"),
        F.bround("baseline_views", 6).alias("baseline_views"),
    )


@query("weak_count")
def weak_count(spark, folder):
    return engagement.weak_summary(_settled(spark, folder)).select("total_weak_count")


def _yes_no(name, flag):
    @query(name)
    def means(spark, folder):
        return totals.yes_no_means(*_vd(spark, folder), flag)


_yes_no("avg_views_by_emoji", "non_ascii")
_yes_no("avg_views_by_exclamation", "exclamation")
_yes_no("avg_views_by_question", "question")


@query("avg_views_by_title_bucket")
def avg_views_by_title_bucket(spark, folder):
    means = totals.mean_views_by(*_vd(spark, folder), "length_bucket")
    return means.select(
        titles.length_bucket_name(F.col("level")).alias("bucket"), "videos", "mean_views"
    )


@query("avg_title_length")
def avg_title_length(spark, folder):
    return totals.average_title_length(*_vd(spark, folder))


@query("title_and_time_means")
def title_and_time_means(spark, folder):
    videos, daily = _vd(spark, folder)
    dimensions = list(totals.PROFILE_DIMENSIONS)
    return totals.profile(videos, totals.video_totals(daily), dimensions, CHANNEL).select(
        "channel_id", "dimension", "level", "videos", "views", "mean_views"
    )


@query("views_7d")
def views_7d(spark, folder):
    return totals.first_week_views(*_vd(spark, folder))


def _training(spark, folder):
    return forecast.training_rows(*_vd(spark, folder))


@query("category_distribution")
def category_distribution(spark, folder):
    return forecast.class_distribution(_training(spark, folder))


@query("training_size")
def training_size(spark, folder):
    return _training(spark, folder).agg(F.count("*").alias("trained_on"))


def _series(rows, by=()):
    return rows.select(
        *by,
        "date",
        "views",
        "estimated_minutes_watched",
        F.bround("average_view_duration", 4).alias("average_view_duration"),
        F.bround("average_view_percentage", 4).alias("average_view_percentage"),
        "subscribers_gained",
        "subscribers_lost",
    )


@query("channel_daily_last_n")
def channel_daily_last_n(spark, folder):
    return _series(totals.channel_daily(binding.daily_metrics(spark, folder), SERIES_AS_OF))


@query("channel_daily_last_n_by_channel")
def channel_daily_last_n_by_channel(spark, folder):
    videos, daily = _vd(spark, folder)
    rows = totals.channel_daily(daily, SERIES_AS_OF, videos=videos, by=CHANNEL)
    return _series(rows, CHANNEL)


@query("video_daily_last_n")
def video_daily_last_n(spark, folder):
    rows = totals.video_daily(binding.daily_metrics(spark, folder), ONE_VIDEO, SERIES_AS_OF)
    return rows.withColumn("average_view_percentage", F.bround("average_view_percentage", 6))


@query("video_traffic")
def video_traffic(spark, folder):
    return totals.video_traffic(binding.traffic_sources(spark, folder), ONE_VIDEO)


# Rankings --------------------------------------------------------------------


@query("best_worst_hour")
def best_worst_hour(spark, folder):
    rows = reports.upload_times(*_vd(spark, folder), CHANNEL)
    return rows.select("channel_id", "best_hour", "worst_hour")


@query("best_worst_day")
def best_worst_day(spark, folder):
    rows = reports.upload_times(*_vd(spark, folder), CHANNEL)
    return rows.select("channel_id", "best_day", "worst_day")


@query("top_3_hours")
def top_3_hours(spark, folder):
    return ranking.top_hours(*_vd(spark, folder))


@query("top_3_hours_by_channel")
def top_3_hours_by_channel(spark, folder):
    return ranking.top_hours(*_vd(spark, folder), by=CHANNEL)


def _weak(spark, folder, by=()):
    return engagement.weak_videos(_settled(spark, folder, by), by=by).drop("_order")


@query("weak_videos")
def weak_videos(spark, folder):
    return _weak(spark, folder)


@query("weak_videos_by_channel")
def weak_videos_by_channel(spark, folder):
    return _weak(spark, folder, CHANNEL)


@query("traffic_ranked")
def traffic_ranked(spark, folder):
    shares = totals.traffic_shares(binding.traffic_sources(spark, folder))
    return shares.orderBy(F.desc("total_views"), "traffic_source_type")


@query("top_source")
def top_source(spark, folder):
    return ranking.top_sources(binding.traffic_sources(spark, folder), 1)


@query("top_3_sources")
def top_3_sources(spark, folder):
    return ranking.top_sources(binding.traffic_sources(spark, folder), 3)


@query("top_3_sources_by_channel")
def top_3_sources_by_channel(spark, folder):
    videos, _, traffic = _star(spark, folder)
    return ranking.top_sources(traffic, 3, videos, CHANNEL)


@query("top_videos_20")
def top_videos_20(spark, folder):
    return ranking.top_videos(*_vd(spark, folder), 20)


@query("top_videos_10")
def top_videos_10(spark, folder):
    return ranking.top_videos(*_vd(spark, folder), 10)


@query("top_videos_10_by_channel")
def top_videos_10_by_channel(spark, folder):
    return ranking.top_videos(*_vd(spark, folder), 10, CHANNEL)


@query("best_title_bucket")
def best_title_bucket(spark, folder):
    rows = reports.title_patterns(*_vd(spark, folder), CHANNEL)
    return rows.select("channel_id", "best_title_length_bucket")


@query("latest_videos")
def latest_videos(spark, folder):
    return ranking.latest_videos(binding.videos(spark, folder))


@query("latest_videos_by_channel")
def latest_videos_by_channel(spark, folder):
    return ranking.latest_videos(binding.videos(spark, folder), by=CHANNEL)


@query("chart_traffic_top6")
def chart_traffic_top6(spark, folder):
    return charts.traffic_chart(binding.traffic_sources(spark, folder))


@query("chart_hours")
def chart_hours(spark, folder):
    return charts.hours_chart(*_vd(spark, folder)).drop("position")


@query("chart_hours_by_channel")
def chart_hours_by_channel(spark, folder):
    return charts.hours_chart(*_vd(spark, folder), CHANNEL).drop("position")


@query("chart_days")
def chart_days(spark, folder):
    return charts.days_chart(*_vd(spark, folder)).drop("position")


@query("chart_days_by_channel")
def chart_days_by_channel(spark, folder):
    return charts.days_chart(*_vd(spark, folder), CHANNEL).drop("position")


# Scalar functions ------------------------------------------------------------


@query("publish_time_parts")
def publish_time_parts(spark, folder):
    ts = F.col("ts")
    return binding.table(spark, folder, "events").select(
        "event_id",
        clock.publish_hour(ts).alias("hour"),
        clock.weekday_number(ts).alias("day_of_week"),
        clock.weekday_name(clock.weekday_number(ts)).alias("day"),
        clock.publish_month(ts).alias("month"),
    )


@query("parse_timestamps")
def parse_timestamps(spark, folder):
    """Event times as ISO text, some with an offset, some not parsable, read back."""
    text = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    written = (
        F.when(F.col("event_type") == "view", F.concat(text, F.lit("+02:00")))
        .when(F.col("event_type") == "error", F.concat(F.lit("at "), text))
        .otherwise(F.concat(text, F.lit("Z")))
    )
    parsed = clock.utc_wall_clock(written)
    return binding.table(spark, folder, "events").select(
        "event_id", parsed.alias("published_at"), clock.day_of(parsed).alias("date")
    )


@query("title_flags")
def title_flags(spark, folder):
    title = binding.heading(F.col("text"))
    return binding.table(spark, folder, "documents").select(
        "doc_id",
        titles.has_non_ascii(title).alias("has_emoji"),
        titles.has_exclamation(title).alias("has_exclamation"),
        titles.has_question(title).alias("has_question"),
        titles.has_digit(title).alias("title_has_numbers"),
        titles.title_length(title).alias("title_length"),
        titles.word_count(title).alias("title_word_count"),
    )


@query("text_flags")
def text_flags(spark, folder):
    """The same flags over whole documents, which hold far more characters."""
    text = F.col("text")
    return binding.table(spark, folder, "documents").select(
        "doc_id",
        titles.has_non_ascii(text).alias("has_emoji"),
        titles.has_exclamation(text).alias("has_exclamation"),
        titles.has_question(text).alias("has_question"),
        titles.has_digit(text).alias("title_has_numbers"),
        titles.title_length(text).alias("title_length"),
        titles.word_count(text).alias("title_word_count"),
    )


@query("title_length_bucket")
def title_length_bucket(spark, folder):
    number = titles.length_bucket_number(binding.heading(F.col("text")))
    return binding.table(spark, folder, "documents").select(
        "doc_id", titles.length_bucket_name(number).alias("bucket")
    )


@query("performance_category")
def performance_category(spark, folder):
    rows = totals.video_totals(binding.daily_metrics(spark, folder))
    number = figures.performance_class(F.col("total_views"))
    return rows.select(
        "video_id", number.alias("category"), figures.class_label(number).alias("label")
    )


@query("format_verdict")
def format_verdict(spark, folder):
    rows = reports.video_length(*_vd(spark, folder), CHANNEL)
    return rows.select("channel_id", "better_format", "multiplier", "has_baseline")


@query("iso_duration")
def iso_duration(spark, folder):
    """Sizes written as durations in four shapes, one of which has no time part."""
    n = F.col("n_chars")

    def whole(x):
        return F.floor(x).cast("string")

    text = (
        F.when(F.col("lang") == "en", F.concat(F.lit("PT"), whole(n / 60), F.lit("M"), whole(n % 60), F.lit("S")))
        .when(F.col("lang") == "fr", F.concat(F.lit("PT"), whole(n / 3600), F.lit("H"), whole(n / 60), F.lit("M")))
        .when(F.col("lang") == "de", F.concat(F.lit("P"), whole(n / 86400 + 1), F.lit("DT"), whole(n), F.lit("S")))
        .otherwise(F.concat(F.lit("P"), whole(n), F.lit("D")))
    )
    seconds = figures.duration_seconds(text)
    return binding.table(spark, folder, "documents").select(
        "doc_id",
        seconds.alias("seconds"),
        figures.duration_seconds(text, count_days=True).alias("seconds_with_days"),
        figures.short_flag(seconds).cast("bigint").alias("is_short"),
    )


@query("compact_number")
def compact_number(spark, folder):
    """Orders and order value per customer as display text."""
    per_customer = (
        binding.table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.round("o_totalprice").cast("bigint")).alias("total"),
        )
    )
    return per_customer.select(
        "o_custkey",
        figures.compact_number(F.col("n")).alias("orders"),
        figures.compact_number(F.col("total")).alias("value"),
        figures.compact_number(F.col("total") / 20).alias("twentieth"),
    )


@query("display_name")
def display_name(spark, folder):
    return binding.table(spark, folder, "part").select(
        "p_partkey",
        figures.display_name(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("type"),
        figures.display_name(F.col("p_name")).alias("name"),
    )


# Reports ---------------------------------------------------------------------


def _report(name, build):
    QUERIES[name] = lambda spark, folder: build(spark, folder, [])
    QUERIES[f"{name}_by_channel"] = lambda spark, folder: build(spark, folder, CHANNEL)


def _scaled(value, factor):
    """A double as a whole number of its fractions, to be written the same by every engine."""
    return F.bround(value * factor, 0).cast("bigint").cast("string")


def _fields(*parts):
    return F.concat_ws(":", *parts)


def _entries(column, text):
    """A map as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), text)), "|")


# Lists and maps of the reports as text.
SHOWN = {
    "top_3_hours": lambda c: F.array_join(c.cast("array<string>"), "|"),
    "hour_data": lambda c: _entries(c, lambda e: _fields(e["key"].cast("string"), _scaled(e["value"], 1000))),
    "day_data": lambda c: F.concat_ws(
        "|", *[_fields(F.lit(d), F.coalesce(_scaled(c[d], 1000), F.lit("-"))) for d in DAY_NAMES]
    ),
    "length_performance": lambda c: _entries(c, lambda e: _fields(e["key"], e["value"].cast("string"))),
    "top_3_sources": lambda c: F.array_join(c, "|"),
    "sources": lambda c: _entries(
        c,
        lambda e: _fields(
            e["key"], e["value"]["total_views"].cast("string"), _scaled(e["value"]["percentage"], 10)
        ),
    ),
    "weak_videos": lambda c: F.array_join(
        F.transform(
            c,
            lambda v: _fields(
                v["video_id"],
                v["title"],
                _scaled(v["avg_retention"], 10),
                v["total_views"].cast("string"),
                v["net_subs"].cast("string"),
                _scaled(v["below_avg_by"], 10),
            ),
        ),
        "|",
    ),
}


def _as_text(rows, by, nested=()):
    """Plain columns of a report, or of the reports nested in a row."""
    columns = [F.col(f"{n}.{c}") for n in nested for c in rows.select(f"{n}.*").columns]
    names = [c for n in nested for c in rows.select(f"{n}.*").columns]
    if not nested:
        names = [c for c in rows.columns if c not in by]
        columns = [F.col(c) for c in names]
    same = lambda c: c
    return rows.select(*by, *[SHOWN.get(n, same)(c).alias(n) for n, c in zip(names, columns, strict=True)])


def _upload_times(spark, folder, by):
    return _as_text(reports.upload_times(*_vd(spark, folder), by), by)


def _title_patterns(spark, folder, by):
    return _as_text(reports.title_patterns(*_vd(spark, folder), by), by)


def _traffic(spark, folder, by):
    videos, _, traffic = _star(spark, folder)
    return _as_text(reports.traffic(traffic, videos, by), by)


def _weak_engagement(spark, folder, by):
    return _as_text(reports.weak_engagement(*_vd(spark, folder), by=by), by)


def _all_patterns(spark, folder, by):
    """Every column of the nested report, lists and maps as text."""
    nested = ["upload_times", "video_length", "traffic", "weak_engagement", "title_patterns"]
    return _as_text(reports.all_patterns(*_star(spark, folder), by), by, nested)


def _all_patterns_flat(spark, folder, by):
    """Plain columns of the nested report."""
    return reports.all_patterns(*_star(spark, folder), by).select(
        *by,
        "upload_times.best_hour",
        "upload_times.worst_day",
        "upload_times.best_day_avg_views",
        "video_length.better_format",
        "video_length.multiplier",
        "video_length.longform_total_views",
        "traffic.top_source",
        "traffic.top_source_percentage",
        "weak_engagement.channel_avg_retention",
        "weak_engagement.total_weak_count",
        F.array_join(
            F.transform("weak_engagement.weak_videos", lambda v: v["video_id"]), "|"
        ).alias("weak_videos"),
        "title_patterns.emoji_helps",
        "title_patterns.best_title_length_bucket",
        "title_patterns.avg_title_length",
    )


_report("upload_times", _upload_times)
_report("all_patterns_flat", _all_patterns_flat)
_report("video_length", lambda s, f, by: reports.video_length(*_vd(s, f), by))
_report("traffic", _traffic)
_report("weak_engagement", _weak_engagement)
_report("title_patterns", _title_patterns)
_report("all_patterns", _all_patterns)
_report("kpi_tiles", lambda s, f, by: reports.kpi_tiles(*_vd(s, f), by))


def _kept(spark, folder, by):
    """Reports kept through two loads: the second corrects a third of the rows and adds another.

    The first load has a third of the days and sources with other views, a quarter of the videos
    with another title and format, and lacks a quarter of the videos.
    """
    videos, daily, traffic = _star(spark, folder)
    fetched = [F.lit(f"2024-02-0{i} 00:00:00").cast("timestamp_ntz") for i in (1, 2)]

    def share(n, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(n))

    def loads(rows, *keys):
        kind = share(3, *keys)
        early = F.when(kind == 0, F.col("views") * 3 + 1).otherwise(F.col("views"))
        return (
            rows.filter(kind != 2).withColumn("views", early).withColumn("fetched_at", fetched[0]),
            rows.filter(kind != 1).withColumn("fetched_at", fetched[1]),
        )

    kind = share(4, "video_id")
    other = {"title": F.concat("title", F.lit(" !?")), "is_short": 1 - F.col("is_short")}
    early = {c: F.when(kind == 0, value).otherwise(F.col(c)) for c, value in other.items()}
    seen = (videos.filter(kind != 1).withColumns(early), videos.filter(kind < 2))
    days, sources = loads(daily, "video_id", "date"), loads(traffic, "video_id", "traffic_source_type")
    kept = KeptReports(spark, fresh_folder(spark, "kept"), by)
    stored = (None, None)
    for load in range(2):
        changed = [
            upserts.changed_rows(before, rows[load], KEYS[name])
            for before, rows, name in zip(stored, (days, sources), ("daily_metrics", "traffic_sources"))
        ]
        kept.apply(load, load - 1 if load else None, Changes(seen[load], *changed[0], *changed[1]))
        stored = (days[0], sources[0])
    return kept


def _kept_patterns(spark, folder, by):
    nested = ["upload_times", "video_length", "traffic", "weak_engagement", "title_patterns"]
    return _as_text(_kept(spark, folder, by).all_patterns(1), by, nested)


_report("kept_patterns", _kept_patterns)
_report("kept_kpi_tiles", lambda s, f, by: _kept(s, f, by).kpi_tiles(1))


# Forecast --------------------------------------------------------------------


@query("ml_features")
def ml_features(spark, folder):
    return _training(spark, folder).select("video_id", *FEATURES, "views_7d", "category")


@query("ml_folds")
def ml_folds(spark, folder):
    return forecast.folds(_training(spark, folder)).select("video_id", "category", "fold")


def _fitted(spark, folder):
    return forecast.kept_fit(_training(spark, folder))


@query("ml_fit")
def ml_fit(spark, folder):
    """Per class: its trees, the videos behind them, where its scores start, and its first split."""
    model = _fitted(spark, folder)
    booster = model.booster
    rows = []
    for c, start, first in zip(booster.classes, booster.start, booster.rounds[0]):
        split = (FEATURES[first.feature[0]], float(first.threshold[0]))
        rows.append((c, len(booster.rounds), model.trained_on, round(start, 9), *split))
    schema = "category bigint, trees bigint, trained_on bigint, start double, feature string, threshold double"
    return spark.createDataFrame(rows, schema)


@query("ml_cv_predictions")
def ml_cv_predictions(spark, folder):
    return forecast.cross_predictions(_training(spark, folder))


@query("ml_cv_accuracy")
def ml_cv_accuracy(spark, folder):
    return forecast.accuracy(ml_cv_predictions(spark, folder))


@query("ml_importance")
def ml_importance(spark, folder):
    return forecast.importance(spark, _fitted(spark, folder))


@query("chart_importance")
def chart_importance(spark, folder):
    return forecast.importance_chart(ml_importance(spark, folder))


def _slotted(spark, folder):
    vd = _vd(spark, folder)
    slots, overall = (reports.upload_times(*vd, by) for by in (CHANNEL, []))
    return forecast.slot_features(binding.candidates(spark, folder), slots, 2, CHANNEL, overall)


@query("ml_predict")
def ml_predict(spark, folder):
    """Class forecast for every unpublished document at its channel's best slot."""
    rows = _slotted(spark, folder)
    return forecast.predict(_fitted(spark, folder), rows).select(
        "doc_id", "channel_id", "predicted_class", "predicted_category", "probabilities"
    )


@query("ml_best_slots")
def ml_best_slots(spark, folder):
    """The hour and weekday at which every unpublished document is expected to do best, of all in a week."""
    rows = _slotted(spark, folder).drop(*slots.WEEK)
    return slots.best_slots(_fitted(spark, folder), rows).select(
        "doc_id", "channel_id", "slot.hour", "slot.day_of_week", "expected_class", "predicted_class",
        "predicted_category", "probabilities",
    )


@query("candidate_features")
def candidate_features(spark, folder):
    return _slotted(spark, folder).select("doc_id", "channel_id", *FEATURES)


@query("ml_metrics")
def ml_metrics(spark, folder):
    return forecast.metrics(_training(spark, folder))


@query("chart_distribution")
def chart_distribution(spark, folder):
    return forecast.distribution_chart(_training(spark, folder))


# Context and replies ---------------------------------------------------------


def _context_upload(spark, folder, by):
    rows = context.upload_context(*_vd(spark, folder), by)
    return rows.withColumn("top_3_hours", _listed("top_3_hours"))


def _context_next(spark, folder, by):
    rows = context.next_videos_context(*_vd(spark, folder), by)
    return rows.withColumn("top_titles", F.array_join("top_titles", "|"))


def _context_title_thumbnail(spark, folder, by):
    candidates = binding.candidates(spark, folder).select(*by, "doc_id", "title")
    rows = context.title_thumbnail_context(candidates, *_star(spark, folder), by)
    return rows.withColumn("top_titles", F.array_join("top_titles", "|"))


_report("context_upload", _context_upload)
_report("context_titles", lambda s, f, by: context.title_context(*_vd(s, f), "travel", by))
_report("context_weak_video", lambda s, f, by: context.weak_video_context(*_vd(s, f), by=by))
_report("context_thumbnail", lambda s, f, by: context.thumbnail_context(*_star(s, f), by))
_report("context_audit", lambda s, f, by: context.audit_context(*_star(s, f), by))
_report("context_next_videos", _context_next)
_report("context_title_thumbnail", _context_title_thumbnail)


def _context_fingerprints(spark, folder, by):
    """What every kind of reply would be stored under; the candidate titles are those of the forecast."""
    candidates = binding.candidates(spark, folder).select(*by, "title")
    return context.fingerprints(*_star(spark, folder), candidates, "provider", "model", "travel", by)


_report("context_fingerprints", _context_fingerprints)


@query("normalise_responses")
def normalise_responses(spark, folder):
    rows = replies.normalise(binding.responses(spark, folder))
    return rows.select("cache_key", "created_at", "reply", "error", "raw")


@query("responses_live")
def responses_live(spark, folder):
    return replies.live(binding.responses(spark, folder), REPLIES_AS_OF)


@query("upsert_responses")
def upsert_responses(spark, folder):
    rows = binding.responses(spark, folder)
    half = F.lit(HALFWAY).cast("timestamp_ntz")
    stored = replies.upsert_replies(None, rows.filter(F.col("created_at") < half))
    return replies.upsert_replies(stored, rows.filter(F.col("created_at") >= half))


@query("context_fingerprint")
def context_fingerprint(spark, folder):
    """Upload contexts whose reply is not stored under their present statistics.

    Replies are stored for the channels of two languages, next to those of the events.
    """
    rows = context.upload_context(*_vd(spark, folder), CHANNEL)
    keys = context.fingerprint(rows, "upload_strategy", "provider", "model", CHANNEL)
    answered = keys.filter(F.col("channel_id").isin("c_de", "c_fr")).select("cache_key")
    stored = binding.responses(spark, folder).select("cache_key").union(answered)
    return context.unanswered(keys, stored).select("channel_id", "cache_key")
