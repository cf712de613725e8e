"""Table schemas and the fixed vocabularies shared by every module.

Timestamps are UTC wall clock without a zone, so no result depends on the
session time zone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _LONG, _INT, _DBL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_NTZ, _DATE = T.TimestampNTZType(), T.DateType()


def _table(*fields, required=()):
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


# The columns, types and required columns of the four tables.
VIDEOS = _table(
    ("video_id", _STR),
    ("channel_id", _STR),
    ("title", _STR),
    ("description", _STR),
    ("published_at", _NTZ),
    ("duration_seconds", _LONG),
    ("category_id", _STR),
    ("thumbnail_url", _STR),
    ("is_short", _INT),
    ("created_at", _NTZ),
    ("updated_at", _NTZ),
    required=("video_id", "channel_id", "published_at"),
)

DAILY_METRICS = _table(
    ("video_id", _STR),
    ("date", _DATE),
    ("views", _LONG),
    ("estimated_minutes_watched", _LONG),
    ("average_view_duration", _LONG),
    ("average_view_percentage", _DBL),
    ("subscribers_gained", _LONG),
    ("subscribers_lost", _LONG),
    ("fetched_at", _NTZ),
    required=("video_id", "date"),
)

TRAFFIC_SOURCES = _table(
    ("video_id", _STR),
    ("traffic_source_type", _STR),
    ("views", _LONG),
    ("estimated_minutes_watched", _LONG),
    ("fetched_at", _NTZ),
    required=("video_id", "traffic_source_type"),
)

RESPONSES = _table(
    ("cache_key", _STR),
    ("response", _STR),
    ("created_at", _NTZ),
    required=("cache_key", "response"),
)

# Row identity per table.
KEYS = {
    "videos": ["video_id"],
    "daily_metrics": ["video_id", "date"],
    "traffic_sources": ["video_id", "traffic_source_type"],
}

# Value a column takes when the incoming rows do not carry it at all.
COLUMN_DEFAULTS = {
    "is_short": 0,
    "views": 0,
    "estimated_minutes_watched": 0,
    "average_view_duration": 0,
    "average_view_percentage": 0.0,
    "subscribers_gained": 0,
    "subscribers_lost": 0,
}

# Weekday names, Monday first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# View-class labels for classes 0 to 3, and the lower bounds of 1 to 3.
CLASS_LABELS = ["Low (<10K)", "Medium (10K-100K)", "High (100K-1M)", "Viral (1M+)"]
CLASS_BOUNDS = [10_000, 100_000, 1_000_000]

# Title-length buckets and their inclusive upper bounds.
LENGTH_BUCKETS = ["short", "medium", "long", "very_long"]
LENGTH_BOUNDS = [30, 50, 70, 200]

# Classifier inputs in model order.
FEATURES = [
    "hour",
    "day_of_week",
    "month",
    "title_length",
    "has_emoji",
    "has_exclamation",
    "has_question",
    "title_word_count",
    "title_has_numbers",
]


def label_for(labels: list[str], ordinal: Column) -> Column:
    """The label at a 0-based position, null when the position is null."""
    return F.get(F.array(*[F.lit(x) for x in labels]), ordinal.cast("int"))


def conform(rows: DataFrame, schema: T.StructType, loaded_at: Column) -> DataFrame:
    """Shape rows to a table schema.

    Absent metric columns take their default, absent load times take
    ``loaded_at``, other absent columns become null. Present nulls stay null.
    """
    load_times = {"created_at", "updated_at", "fetched_at"}

    def column(field):
        if field.name in rows.columns:
            value = F.col(field.name)
        elif field.name in load_times:
            value = loaded_at
        else:
            value = F.lit(COLUMN_DEFAULTS.get(field.name))
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in schema.fields])
