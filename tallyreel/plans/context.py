"""Compact per-group context tables drawn from the reports, and their fingerprint."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.functions import canonical
from tallyreel.operators import engagement
from tallyreel.operators.grouping import attach, beside
from tallyreel.operators.ranking import top_videos
from tallyreel.operators.totals import described_videos, profile, profile_rows, video_totals
from tallyreel.plans import reports

NEXT_TITLES = 15
COMPARED_TITLES = 10


def _only(frame: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    return frame.select(*by, *columns)


def _format_and_titles(videos: DataFrame, daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Format comparison and title patterns from one profile pass."""
    dimensions = [*reports.FORMAT_DIMENSIONS, *reports.TITLE_DIMENSIONS]
    return profile(videos, video_totals(daily), dimensions, by).groupBy(*by).agg(
        *reports.format_columns(), *reports.title_columns()
    )


def upload_context(videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _only(
        reports.upload_times(videos, daily, by),
        by,
        "best_hour",
        "best_hour_avg_views",
        "worst_hour",
        "best_day",
        "best_day_avg_views",
        "worst_day",
        "top_3_hours",
    )


def title_context(
    videos: DataFrame, daily: DataFrame, topic: str = "", by: Sequence[str] = ()
) -> DataFrame:
    return reports.title_patterns(videos, daily, by).select(
        *by,
        "emoji_helps",
        "avg_views_with_emoji",
        "avg_views_without_emoji",
        "exclamation_helps",
        "avg_views_with_exclamation",
        "avg_views_without_exclamation",
        "best_title_length_bucket",
        "avg_title_length",
        F.nullif(F.lit(topic), F.lit("")).alias("topic"),
    )


def weak_video_context(
    videos: DataFrame,
    daily: DataFrame,
    n: int = engagement.WEAK_VIDEOS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Each weak video next to its group's means and better format."""
    described = described_videos(videos, daily, reports.FORMAT_DIMENSIONS, by)
    weak = reports.weak_report(engagement.engaged_of(described, by), n, by)
    levels = profile_rows(described, reports.FORMAT_DIMENSIONS, by)
    formats = levels.groupBy(*by).agg(*reports.format_columns()).select(
        *by, "better_format", "multiplier", "has_baseline"
    )
    return (
        beside(weak, [formats], by)
        .select("*", F.explode("weak_videos").alias("v"))
        .select(
            *by,
            "v.video_id",
            "v.title",
            "v.avg_retention",
            "v.total_views",
            "channel_avg_retention",
            "channel_avg_views",
            "better_format",
            "multiplier",
            "has_baseline",
        )
    )


def thumbnail_context(
    videos: DataFrame, daily: DataFrame, traffic: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    facts = _only(
        _format_and_titles(videos, daily, by),
        by,
        "better_format",
        "multiplier",
        "has_baseline",
        "emoji_helps",
    )
    return beside(facts, [_only(reports.traffic(traffic, videos, by), by, "top_source")], by)


def audit_context(
    videos: DataFrame, daily: DataFrame, traffic: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    dimensions = [*reports.UPLOAD_DIMENSIONS, *reports.FORMAT_DIMENSIONS]
    described = described_videos(videos, daily, dimensions, by)
    patterns = profile_rows(described, dimensions, by).groupBy(*by).agg(
        *reports.upload_columns(), *reports.format_columns()
    )
    return beside(
        _only(
            patterns,
            by,
            "best_day",
            "best_hour",
            "better_format",
            "multiplier",
            "has_baseline",
            "total_shorts",
            "total_longform",
        ),
        [
            _only(
                reports.traffic(traffic, videos, by), by, "top_source", "top_source_percentage"
            ),
            _only(
                engagement.weak_summary(engagement.engaged_of(described, by), by),
                by,
                "channel_avg_retention",
                "total_weak_count",
            ),
        ],
        by,
    )


def _best_titles(videos: DataFrame, daily: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The n most viewed titles per group, best first, as a list."""
    best = top_videos(videos, daily, n, by)
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("total_views")).alias("o"), "video_id", "title"))
    )
    return best.groupBy(*by).agg(F.transform(ordered, lambda v: v["title"]).alias("top_titles"))


def next_videos_context(
    videos: DataFrame, daily: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    facts = _only(
        _format_and_titles(videos, daily, by),
        by,
        "better_format",
        "multiplier",
        "has_baseline",
        "emoji_helps",
        "best_title_length_bucket",
    )
    return beside(facts, [_best_titles(videos, daily, NEXT_TITLES, by)], by)


def title_thumbnail_context(
    candidates: DataFrame,
    videos: DataFrame,
    daily: DataFrame,
    traffic: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """Each candidate title with its group's best titles and facts."""
    facts = beside(
        _only(_format_and_titles(videos, daily, by), by, "emoji_helps", "better_format"),
        [
            _only(reports.traffic(traffic, videos, by), by, "top_source"),
            _best_titles(videos, daily, COMPARED_TITLES, by),
        ],
        by,
    )
    return attach(candidates, facts, by, ["title"])


def fingerprint(context: DataFrame, kind: str, provider: str, model: str, by: Sequence[str] = ()):
    """md5 over a context row, the kind of reply and who wrote it.

    Columns are taken in name order, so their order in the table does not matter.
    """
    facts = sorted(c for c in context.columns if c not in by)
    text = F.concat(F.to_json(F.struct(*facts)), F.lit(kind), F.lit(provider), F.lit(model))
    return context.select(*by, F.md5(text.cast("binary")).alias("cache_key"))


def fingerprints(
    videos: DataFrame,
    daily: DataFrame,
    traffic: DataFrame,
    candidates: DataFrame,
    provider: str,
    model: str,
    topic: str = "",
    by: Sequence[str] = (),
) -> DataFrame:
    """``by, kind, subject, cache_key`` of every reply that the statistics call for.

    The key is the md5 of the statistics as JSON with sorted keys, the kind (with the topic for title ideas), the
    provider and the model, so a key changes when its statistics do, whatever the order of columns or rows.
    subject is the weak video's id or the candidate title, else null. The facts are read once; a report that a
    group lacks is an empty object. Candidates have ``by`` and title; a repeated title gives one row.
    """
    patterns = reports.all_patterns(videos, daily, traffic, by)
    kinds = {f.name: f.dataType for f in patterns.schema.fields if f.name not in by}
    strings = T.ArrayType(T.StringType())
    best = F.coalesce("top_titles", F.array().cast(strings))
    texts = beside(patterns, [_best_titles(videos, daily, NEXT_TITLES, by)], by).select(
        *by,
        *[
            F.when(F.col(n).isNull(), "{}").otherwise(canonical.json(F.col(n), t)).alias(n) for n, t in kinds.items()
        ],
        *[
            canonical.json(F.slice(best, 1, n), strings).alias(f"top_{n}")
            for n in (COMPARED_TITLES, NEXT_TITLES)
        ],
        F.transform(
            "weak_engagement.weak_videos",
            lambda v: F.struct(
                v["video_id"].alias("subject"),
                canonical.json_object(
                    {
                        "title": canonical.json(v["title"], T.StringType()),
                        "retention": canonical.json(v["avg_retention"], T.DoubleType()),
                        "views": canonical.json(v["total_views"], T.LongType()),
                    }
                ).alias("statistics"),
            ),
        ).alias("weak_rows"),
    )

    def made(**members):
        return canonical.json_object({n: F.col(c) for n, c in members.items()})

    def named(*names):
        return {n: n for n in names}

    whole = {
        "upload_strategy": F.col("upload_times"),
        f"title_ideas_{topic}": F.col("title_patterns"),
        "thumbnail": made(**named("traffic", "title_patterns", "video_length")),
        "channel_audit": made(**named(*kinds)),
        "next_video_ideas": made(titles=f"top_{NEXT_TITLES}", **named("title_patterns", "video_length")),
    }
    per_group = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("subject"), t.alias("statistics"))
            for k, t in whole.items()
        ]
    )
    per_video = F.transform(
        F.coalesce("weak_rows", F.array().cast(texts.schema["weak_rows"].dataType)),
        lambda r: F.struct(F.lit("weak_video").alias("kind"), r["subject"], r["statistics"]),
    )
    rows = texts.select(*by, F.explode(F.concat(per_group, per_video)).alias("r")).select(*by, "r.*")
    facts = texts.select(*by, "traffic", "title_patterns", f"top_{COMPARED_TITLES}")
    planned = attach(candidates.select(*by, "title").distinct(), facts, by, ["title"])
    compared = canonical.json_object(
        {
            "title": canonical.json(F.col("title"), T.StringType()),
            "top_titles": F.coalesce(f"top_{COMPARED_TITLES}", F.lit("[]")),
            "traffic": F.coalesce("traffic", F.lit("{}")),
            "title_patterns": F.coalesce("title_patterns", F.lit("{}")),
        }
    )
    planned = planned.select(
        *by, F.lit("thumbnail_from_title").alias("kind"), F.col("title").alias("subject"), compared.alias("statistics")
    )
    key = F.md5(F.concat("statistics", "kind", F.lit(provider), F.lit(model)).cast("binary"))
    return rows.unionByName(planned).select(*by, "kind", "subject", key.alias("cache_key"))


def unanswered(fingerprints: DataFrame, stored: DataFrame) -> DataFrame:
    """Fingerprints with no stored reply: groups whose statistics changed."""
    return fingerprints.join(stored.select("cache_key"), "cache_key", "left_anti")
