"""Star tables stored in parts, with a manifest that is switched last.

A part is a month of daily metrics or a share of the videos. A load merges the parts it
touches into a new folder and then puts a manifest in place: which folder holds each part
from now on. A load that dies before that leaves the table as it was, and can be repeated. Of
two loads at once only one can put the next manifest in place, on file systems whose rename
refuses an existing name; the other merges again on top of it.
"""

import datetime as dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel import schemas
from tallyreel.operators.upserts import upsert, upsert_videos
from tallyreel.sources.store import settle

SCHEMAS = {
    "videos": schemas.VIDEOS,
    "daily_metrics": schemas.DAILY_METRICS,
    "traffic_sources": schemas.TRAFFIC_SOURCES,
}
# Parts of the tables that have no date.
SHARES = 64
_MANIFEST = "part string, folder string"


def _part(table: str) -> Column:
    if table == "daily_metrics":
        return F.date_format("date", "yyyy-MM")
    return F.lpad(F.pmod(F.xxhash64("video_id"), F.lit(SHARES)).cast("string"), 2, "0")


def _merge(table: str, rows: DataFrame) -> DataFrame:
    return upsert_videos(None, rows) if table == "videos" else upsert(None, rows, schemas.KEYS[table])


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the newest version, 0 without one, and the folder of each of its parts.

    Months and shares are few, so the rows of one version are too.
    """
    try:
        rows = spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{path}/manifests")
    except AnalysisException:
        return 0, {}
    newest = rows.agg(F.max("version").alias("v")).first()["v"]
    found = rows.filter(F.col("version") == newest).collect()
    return newest or 0, {r["part"]: r["folder"] for r in found}


def _read_parts(spark: SparkSession, path: str, table: str, folders: dict[str, str], parts) -> DataFrame:
    schema = SCHEMAS[table]
    paths = [f"{path}/data/{folders[p]}/part={p}" for p in sorted(parts) if p in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table as of its newest version, with its fixed schema."""
    folders = _manifest(spark, path)[1]
    return _read_parts(spark, path, table, folders, folders)


def read_days(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """Stored daily metrics of a span of days; only the folders of its months are read."""
    folders = _manifest(spark, path)[1]
    months = [m for m in folders if f"{start:%Y-%m}" <= m <= f"{end:%Y-%m}"]
    rows = _read_parts(spark, path, "daily_metrics", folders, months)
    return rows.filter(F.col("date").between(F.lit(start), F.lit(end)))


def stage(spark: SparkSession, path: str, table: str, rows: DataFrame) -> dict[str, str]:
    """Write rows to a new folder by part; where each part then lies.

    Ranges over (part, video) keep the tasks even when one part holds most rows. Sorted
    files have narrow spans of videos per row group, which a filter on the video skips.
    """
    folder = uuid.uuid4().hex
    order = ["part", *schemas.KEYS[table]]
    placed = settle(rows.withColumn("part", _part(table)), "parts")
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.partitionBy("part").parquet(f"{path}/data/{folder}")
    return {r["part"]: folder for r in placed.select("part").distinct().collect()}


def _rename_to_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the new name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(files.makeQualified(hadoop.Path(source)), files.makeQualified(path), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


def commit(spark: SparkSession, path: str, version: int, folders: dict[str, str]) -> bool:
    """Put a version's manifest in place; False if another load was first."""
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    rows = spark.createDataFrame(sorted(folders.items()), _MANIFEST).coalesce(1)
    rows.write.parquet(staged)
    return _rename_to_new(spark, staged, f"{path}/manifests/version={version}")


def write_table(rows: DataFrame, path: str, table: str) -> None:
    """Make a stored table's next version from these rows alone, for example to create it."""
    spark = rows.sparkSession
    folders = stage(spark, path, table, rows.select(*SCHEMAS[table].names))
    done = not folders
    while not done:
        done = commit(spark, path, _manifest(spark, path)[0] + 1, folders)


def upsert_stored(spark: SparkSession, path: str, table: str, incoming: DataFrame) -> None:
    """Merge rows into a stored table, rewriting only the parts they touch."""
    batch = settle(incoming.select(*SCHEMAS[table].names), "batch")
    touched = [r["part"] for r in batch.select(_part(table).alias("part")).distinct().collect()]
    done = not touched
    while not done:
        version, folders = _manifest(spark, path)
        stored = _read_parts(spark, path, table, folders, touched)
        merged = _merge(table, stored.unionByName(batch))
        done = commit(spark, path, version + 1, {**folders, **stage(spark, path, table, merged)})
