"""Small star tables for hand-computed cases."""

import datetime as dt

from tallyreel import schemas

MONDAY = dt.datetime(2024, 1, 1, 9, 0)


def videos(spark, *rows):
    """Rows are dicts; a missing channel, title or publish time gets a default."""
    full = [
        (
            r["id"],
            r.get("channel", "c"),
            r.get("title", "plain"),
            r.get("published", MONDAY),
            r.get("short", 0),
        )
        for r in rows
    ]
    return spark.createDataFrame(
        full,
        "video_id string, channel_id string, title string, published_at timestamp_ntz, is_short int",
    )


def daily(spark, *rows):
    """Rows are (video, day of January or date, views[, retention[, gained[, lost]]])."""
    full = []
    for r in rows:
        day = r[1] if isinstance(r[1], dt.date) else dt.date(2024, 1, r[1])
        rest = (*r[2:], *(10.0, 0, 0)[len(r) - 3 :])
        full.append((r[0], day, rest[0], 0, 0, float(rest[1]), rest[2], rest[3], None))
    return spark.createDataFrame(full, schemas.DAILY_METRICS)


def traffic(spark, *rows):
    full = [(video, source, views, 0, None) for video, source, views in rows]
    return spark.createDataFrame(full, schemas.TRAFFIC_SOURCES)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def evaluate(spark, values, expression, kind="string"):
    """The expression's value for each input, in order."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]
