"""Where operators put rows that several later steps read."""

import contextlib
import functools
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
# Text bytes that one chunk of documents holds, and so about what one task works on.
CHUNK_BYTES = 16 << 20
# Spark writes no more files of one bucketed table than this.
MOST_FILES = 100_000
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session may leave it unset (tests do); it gets a folder of its own.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="llm-"))
    return _own_folder[0]


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let Python workers import this package from where the driver found it.

    Enough where all machines have it at one path; else it goes along as ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        return query(spark, *args)

    return run


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    The files outlive lost executors and cut the lineage. They are the caller's to
    remove once the result is no longer read.
    """
    path = f"{shared_folder(rows.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


Settle = Callable[[DataFrame, str], DataFrame]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Settle]:
    """A settle whose files are removed at the end, for rows that no result reads later."""
    folder = f"{shared_folder(spark)}/llm/scratch-{uuid.uuid4().hex}"

    def own(rows: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        yield own
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bucketed(rows: DataFrame, files: int, column: str, name: str) -> DataFrame:
    """Write rows to the shared folder, bucketed by a column, and read them back.

    Only a table knows its buckets, so one is made for the files and its name dropped again.
    """
    spark = rows.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    (
        rows.write.format("parquet")
        .option("compression", "zstd")
        .option("path", f"{shared_folder(spark)}/llm/{table}")
        .bucketBy(files, column)
        .saveAsTable(table)
    )
    found = spark.table(table)  # from here on it refers to the files
    spark.sql(f"DROP TABLE {table}")
    return found


def settle_in_chunks(rows: DataFrame, chunks: int, name: str) -> DataFrame:
    """Like settle, with the rows of a chunk together (column ``chunk``).

    The files are bucketed by chunk, so grouping by chunk later moves no row again.
    """
    files = min(chunks, MOST_FILES)
    return _bucketed(rows.repartition(files, "chunk"), files, "chunk", name)


def chunk_count(texts: DataFrame, column: str) -> int:
    """Chunks for a table of texts, from the sum of their bytes.

    A chunk holds CHUNK_BYTES or less; small tables are spread over the session's
    shuffle partitions as far as a chunk keeps some rows.
    """
    whole = texts.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    wanted = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(whole / CHUNK_BYTES), min(wanted, 1 + whole // (256 << 10)))


def spread(chunks: int) -> Column:
    """The chunk of a row with columns id and text."""
    return F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(chunks)).cast("int")


def others(rows: DataFrame, *used: str) -> Column:
    """All other columns as one struct, so that their names can't clash with any of an operator."""
    names = [c for c in rows.columns if c not in used]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("boolean")


def task_count(rows: DataFrame, whole: int, most: int, least: int) -> int:
    """Tasks for work of a known size: none above ``most``, and not many below ``least``."""
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(whole / most), min(wanted, math.ceil(whole / least)))




def settle_ranges(rows: DataFrame, ranges: int, order: list[Column], name: str) -> DataFrame:
    """Like settle, with rows dealt to ranges of an order (column ``range``, ascending in it).

    The files are bucketed by range, so a window or group over a range moves no row again.
    """
    files = min(ranges, MOST_FILES)
    placed = rows.repartitionByRange(files, *order).withColumn("range", F.spark_partition_id())
    return _bucketed(placed, files, "range", name)
