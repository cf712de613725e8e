"""New report files to table rows, safe to repeat.

Each micro-batch writes only its own flattened rows, into a folder named by its
number, so a repeated batch replaces itself. What can't be read, or has no key, goes to a
folder of rejects with the reason and the stream goes on. The table is the latest row per key
over the newest compacted version and the batches after it; ``compact`` makes such a version.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel import schemas
from tallyreel.operators.upserts import upsert, upsert_videos
from tallyreel.sources import landing, versions
from tallyreel.sources.store import settle


@dataclass(frozen=True)
class Feed:
    """How one kind of page becomes rows of one table."""

    page: str
    flatten: Callable[[DataFrame], DataFrame]
    rejects: Callable[[DataFrame], DataFrame]
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]


FEEDS = {
    "videos": Feed(
        landing.VIDEO_PAGE,
        landing.video_metadata,
        landing.metadata_rejects,
        schemas.VIDEOS,
        lambda rows: upsert_videos(None, rows),
    ),
    "daily_metrics": Feed(
        landing.REPORT_PAGE,
        landing.daily_report,
        landing.daily_rejects,
        schemas.DAILY_METRICS,
        lambda rows: upsert(None, rows, schemas.KEYS["daily_metrics"]),
    ),
    "traffic_sources": Feed(
        landing.REPORT_PAGE,
        landing.traffic_report,
        landing.traffic_rejects,
        schemas.TRAFFIC_SOURCES,
        lambda rows: upsert(None, rows, schemas.KEYS["traffic_sources"]),
    ),
}


# Files per micro-batch, so that a long backlog is loaded in steps of a known size.
BATCH_FILES = 10_000


def load_new_files(
    spark: SparkSession,
    table: str,
    landed: str,
    sink: str,
    progress: str,
    batch_files: int = BATCH_FILES,
) -> None:
    """Flatten every file that arrived since the last call.

    ``progress`` holds the stream's checkpoint and, like ``sink``, must be on shared
    storage. Files already taken are not read again.
    """
    feed = FEEDS[table]

    def write(lines: DataFrame, number: int) -> None:
        pages = settle(landing.parse_landed(lines, feed.page), "pages")
        feed.rejects(pages).write.mode("overwrite").parquet(f"{sink}/rejects/batch={number}")
        feed.flatten(pages).write.mode("overwrite").parquet(f"{sink}/batches/batch={number}")

    (
        spark.readStream.option("maxFilesPerTrigger", batch_files)
        .text(landed)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _compacted(spark: SparkSession, sink: str) -> int:
    """The last batch that the compacted version holds, -1 without one."""
    try:
        marks = spark.read.schema("batch bigint").parquet(f"{sink}/compacted")
    except AnalysisException:
        return -1
    last = marks.agg(F.max("batch").alias("b")).first()["b"]
    return -1 if last is None else last


def _later_batches(spark: SparkSession, table: str, sink: str) -> DataFrame:
    schema = T.StructType([*FEEDS[table].schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{sink}/batches")
    return rows.filter(F.col("batch") > _compacted(spark, sink))


def current(spark: SparkSession, table: str, sink: str) -> DataFrame:
    """The table as of the last loaded batch. Folders of compacted batches are not read."""
    feed = FEEDS[table]
    later = _later_batches(spark, table, sink).select(*feed.schema.names)
    return feed.merge(versions.read_table(spark, f"{sink}/table", table).unionByName(later))


def rejects(spark: SparkSession, sink: str) -> DataFrame:
    """Everything that could not be loaded: batch, reason and raw text."""
    return spark.read.schema("reason string, raw string, batch bigint").parquet(f"{sink}/rejects")


def compact(spark: SparkSession, table: str, sink: str) -> None:
    """Write the current table as a new version that later reads begin with.

    The mark follows the version. A run that dies in between leaves batches to be merged
    once more with rows that hold them already, which changes nothing.
    """
    last = _later_batches(spark, table, sink).agg(F.max("batch").alias("b")).first()["b"]
    if last is None:
        return
    versions.write_table(settle(current(spark, table, sink), "compacted"), f"{sink}/table", table)
    spark.createDataFrame([(last,)], "batch bigint").write.mode("append").parquet(f"{sink}/compacted")
