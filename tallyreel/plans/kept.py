"""Report tables that loads keep up to date, so that a report reads no fact.

A state holds sums that can be changed by what a load changes: per video its figures, and per
group the figures of each profile level and traffic source. A load brings the touched rows of the
fact as they were and as they are (``upserts.changed_rows``), and the described videos that changed.
Old rows count negative, new ones positive; all are sums of whole numbers (a percentage is split into
some, see ``functions.exact``), so a state that took many loads equals one made from all rows at once.

Reports come from the state: best hours, formats and titles from the levels (43 at most per
group), traffic from the sources, and the weakest videos from the videos' own rows.

Each load writes a folder of its own from that of the load before. Repeating a load writes the
same folder again; a load that died leaves the one before as it was. Whoever runs the loads names
them, as a stream does with its batches.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel.functions import exact, figures
from tallyreel.operators import engagement
from tallyreel.operators.grouping import beside
from tallyreel.operators.totals import WATCHED_PERCENTAGE, described_levels
from tallyreel.plans import reports

DIMENSIONS = [*reports.UPLOAD_DIMENSIONS, *reports.FORMAT_DIMENSIONS, *reports.TITLE_DIMENSIONS]
RETENTION = [f"retention_{i}" for i in range(exact.LIMBS)]
SOURCE = "traffic_source_type"


@dataclass(frozen=True)
class Changes:
    """What a load changed: rows of both facts before and after, and the new rows of videos.

    Videos keep their group columns, as ``upserts.upsert_videos`` keeps them.
    """

    videos: DataFrame
    daily_before: DataFrame
    daily_after: DataFrame
    traffic_before: DataFrame
    traffic_after: DataFrame


def _measures() -> dict[str, Column]:
    """What is summed per video: each figure, and how many rows have one, as a sum of none is null."""
    watched = F.col("average_view_percentage") > 0

    def having(column: str, condition: Column | None = None) -> Column:
        known = F.col(column).isNotNull()
        return (known if condition is None else known & F.coalesce(condition, F.lit(False))).cast("long")

    def over_watched(column: str) -> Column:
        return F.when(watched, F.col(column))

    return {
        "days": F.lit(1).cast("long"),
        "viewed": having("views"),
        "views": F.col("views"),
        "watched": F.coalesce(watched, F.lit(False)).cast("long"),
        **{name: F.expr(part) for name, part in zip(RETENTION, exact.limbs(WATCHED_PERCENTAGE))},
        "unsummed": F.expr(f"NOT {exact.in_range(WATCHED_PERCENTAGE)}").cast("long"),
        "watched_viewed": having("views", watched),
        "watched_views": over_watched("views"),
        "gains": having("subscribers_gained", watched),
        "gained": over_watched("subscribers_gained"),
        "losses": having("subscribers_lost", watched),
        "lost": over_watched("subscribers_lost"),
    }


def _signed(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def _sums(rows: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Signed sums of each measure per key; null counts as nothing."""

    def signed(name: str, value: Column) -> Column:
        known = F.coalesce(value, F.lit(0)).cast("bigint")
        return F.sum(F.when(F.col("sign") < 0, -known).otherwise(known)).cast("bigint").alias(name)

    return rows.groupBy(*keys).agg(*[signed(name, value) for name, value in measures.items()])


def _facts(sums: DataFrame) -> DataFrame:
    """The columns of ``totals.video_facts`` beside those of sums."""
    mean = exact.mean_of(RETENTION, "watched", "unsummed")
    net = F.col("gained") - F.col("lost")
    return sums.withColumns(
        {
            "total_views": F.when(F.col("viewed") > 0, F.col("views")),
            "avg_retention": mean,
            "watched_views": F.when(F.col("watched_viewed") > 0, F.col("watched_views")),
            "net_subs": F.when((F.col("gains") > 0) & (F.col("losses") > 0), net),
        }
    )


def _level_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed figures of every level; rows carry facts, levels and a sign."""
    carried = [*by, "sign", "total_views", "title_chars"]
    long = rows.select(*carried, *DIMENSIONS).unpivot(carried, DIMENSIONS, "dimension", "level")
    measures = {
        "videos": F.lit(1).cast("long"),
        "viewed": F.col("total_views").isNotNull().cast("long"),
        "views": F.col("total_views"),
        "title_chars": F.col("title_chars"),
        "titled": F.col("title_chars").isNotNull().cast("long"),
    }
    return _sums(long.filter("level IS NOT NULL"), [*by, "dimension", "level"], measures)


def _added(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sums of sums; keys of which nothing is left go."""
    rows = reduce(DataFrame.unionByName, parts)
    measures = [c for c in rows.columns if c not in keys]
    summed = rows.groupBy(*keys).agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])
    return summed.filter(reduce(Column.__or__, [F.col(m) != 0 for m in measures]))


class KeptReports:
    """States of one report set in a folder, for one answer or for groups of videos."""

    def __init__(self, spark: SparkSession, folder: str, by: Sequence[str] = ()) -> None:
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), list(by)

    def _write(self, rows: DataFrame, load: int, name: str) -> DataFrame:
        path = f"{self.folder}/load={load}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _read(self, load: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/load={load}/{name}")

    def apply(self, load: int, previous: int | None, changes: Changes) -> None:
        """Write the state after a load from that of the previous one, None for the first."""
        by, measures = self.by, _measures()
        described = ["described", *by, "title", "title_chars", *DIMENSIONS]
        delta = _sums(_signed(changes.daily_before, changes.daily_after), ["video_id"], measures)
        news = changes.videos.select("video_id", *by, "title", *described_levels(DIMENSIONS))
        news = news.withColumn("described", F.lit(True))
        now = F.struct(*[F.coalesce(f"d.{m}", F.lit(0).cast("bigint")).alias(m) for m in measures]).alias("sums")
        about = F.struct(*[F.col(f"n.{c}").alias(c) for c in described]).alias("about")
        touched = delta.alias("d").join(news.alias("n"), "video_id", "full_outer").select("video_id", now, about)

        # One pass over the videos: untouched rows stay, touched ones get both states for the levels.
        none = self.spark.createDataFrame([], touched.schema)
        old = none if previous is None else self._read(previous, "videos").select(*none.columns)
        both = old.alias("o").join(touched.alias("t"), "video_id", "full_outer")
        total = [
            (F.coalesce(f"o.sums.{m}", F.lit(0)) + F.coalesce(f"t.sums.{m}", F.lit(0))).cast("bigint").alias(m)
            for m in measures
        ]
        newest = F.when(F.col("t.about.described"), F.col("t.about")).otherwise(F.col("o.about"))
        merged = both.select(
            "video_id",
            F.struct(*total).alias("sums"),
            newest.alias("about"),
            F.when(F.col("t.sums").isNotNull(), F.struct(F.col("o.sums"), F.col("o.about"))).alias("before"),
            F.col("t.sums").isNotNull().alias("touched"),
        )
        changed = self._write(merged, load, "videos").filter("touched")
        before = changed.filter("before.about.described").select("video_id", "before.*")
        after = changed.filter("about.described").select("video_id", "sums", "about")

        levels = [_level_sums(self._counted(_signed(before, after)), by)]
        keys = [*by, "dimension", "level"]
        if previous is not None:
            levels.append(self._read(previous, "levels"))
        self._write(_added(levels, keys), load, "levels")
        self._apply_traffic(load, previous, changes, before, after)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """Described videos with rows in the fact, as the reports count them."""
        kept = ["sign"] if "sign" in rows.columns else []
        flat = rows.filter("sums.days > 0 AND about.described").select("video_id", *kept, "sums.*", "about.*")
        return _facts(flat)

    def _apply_traffic(
        self, load: int, previous: int | None, changes: Changes, before: DataFrame, after: DataFrame
    ) -> None:
        """Views by source and group; views of videos not yet described wait under the video's name."""
        by = self.by
        keys = [*by, "waiting", SOURCE]
        viewed = F.col("views").isNotNull().cast("long")
        measures = {"rows": F.lit(1).cast("long"), "viewed": viewed, "views": F.col("views")}
        signed = _signed(changes.traffic_before, changes.traffic_after)
        parts = []
        if not by:
            parts.append(_sums(signed.withColumn("waiting", F.lit(None).cast("string")), keys, measures))
        else:
            groups = self._read(load, "videos").filter("about.described")
            groups = groups.select("video_id", *[f"about.{c}" for c in by])
            placed = signed.join(groups.withColumn("known", F.lit(True)), "video_id", "left")
            waiting = F.when(F.col("known").isNull(), F.col("video_id")).alias("waiting")
            parts.append(_sums(placed.select("*", waiting), keys, measures))
        if previous is not None:
            old = self._read(previous, "traffic")
            parts.append(old)
            if by:
                # Videos that this load described take their waiting views along.
                first = after.join(before.select("video_id"), "video_id", "left_anti")
                first = first.select(F.col("video_id").alias("waiting"), *[f"about.{c}" for c in by])
                freed = old.filter("waiting IS NOT NULL").drop(*by).join(first, "waiting")
                parts.append(freed.withColumn("waiting", F.lit(None).cast("string")).select(old.columns))
                nobody = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in by]
                gone = [(-F.col(m)).alias(m) for m in measures]
                parts.append(freed.select(*nobody, "waiting", SOURCE, *gone))
        self._write(_added(parts, keys), load, "traffic")

    def levels(self, load: int) -> DataFrame:
        """Profile rows as ``totals.profile_rows`` has them."""
        rows = self._read(load, "levels").filter("videos > 0")
        rows = rows.withColumn("views", F.when(F.col("viewed") > 0, F.col("views"))).drop("viewed")
        return rows.withColumn("mean_views", figures.ratio(F.col("views"), F.col("videos")))

    def videos(self, load: int) -> DataFrame:
        """Videos with facts, groups and titles."""
        return self._counted(self._read(load, "videos"))

    def upload_times(self, load: int) -> DataFrame:
        return self.levels(load).groupBy(*self.by).agg(*reports.upload_columns())

    def video_length(self, load: int) -> DataFrame:
        return self.levels(load).groupBy(*self.by).agg(*reports.format_columns())

    def title_patterns(self, load: int) -> DataFrame:
        return self.levels(load).groupBy(*self.by).agg(*reports.title_columns())

    def traffic(self, load: int) -> DataFrame:
        rows = self._read(load, "traffic").filter("rows > 0 AND waiting IS NULL")
        views = F.when(F.col("viewed") > 0, F.col("views")).alias("views")
        return reports.traffic(rows.select(*self.by, SOURCE, views), None, self.by)

    def weak_engagement(self, load: int) -> DataFrame:
        return reports.weak_report(engagement.engaged_of(self.videos(load), self.by), by=self.by)

    def all_patterns(self, load: int) -> DataFrame:
        """All five reports as nested columns of one row per group."""
        by = self.by
        patterns = self.levels(load).groupBy(*by).agg(
            F.struct(*reports.upload_columns()).alias("upload_times"),
            F.struct(*reports.format_columns()).alias("video_length"),
            F.struct(*reports.title_columns()).alias("title_patterns"),
        )
        others = {"traffic": self.traffic(load), "weak_engagement": self.weak_engagement(load)}
        nested = [
            r.select(*by, F.struct(*[c for c in r.columns if c not in by]).alias(n)) for n, r in others.items()
        ]
        names = ["upload_times", "video_length", "traffic", "weak_engagement", "title_patterns"]
        return beside(patterns, nested, by).select(*by, *names)

    def kpi_tiles(self, load: int) -> DataFrame:
        """Headline figures as display text."""
        weak = engagement.weak_summary(engagement.engaged_of(self.videos(load), self.by), self.by)
        return reports.tiles(self.video_length(load), weak, self.by)
