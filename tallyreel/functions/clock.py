"""Publish-time parts and timestamp parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyreel.schemas import DAY_NAMES, label_for


def publish_hour(ts: Column) -> Column:
    return F.hour(ts).cast("bigint")


def weekday_number(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("bigint")


def weekday_name(number: Column) -> Column:
    return label_for(DAY_NAMES, number)


def publish_month(ts: Column) -> Column:
    return F.month(ts).cast("bigint")


def utc_wall_clock(text: Column) -> Column:
    """ISO 8601 text to its UTC wall clock, null when unparsable.

    Text without an offset is UTC. Built from the epoch offset rather than a zone
    conversion, so the answer is the same under every session time zone.
    """
    trimmed = F.trim(text)
    zoned = trimmed.rlike(r"([Zz]|[+-]\d{1,2}(:?\d{2}){0,2}|[A-Za-z]+(/[A-Za-z_]+)*)$") & trimmed.rlike("[:Tt ]")
    date_only = trimmed.rlike(r"^[+-]?\d+-\d{1,2}-\d{1,2}$")
    dated = F.when(date_only, F.concat(trimmed, F.lit("T00:00:00Z"))).when(zoned, trimmed)
    micros = F.unix_micros(F.try_to_timestamp(dated.otherwise(F.concat(trimmed, F.lit("Z")))))
    seconds = micros.cast("decimal(24,6)") / F.lit(1_000_000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def days_after(day: Column, ts: Column) -> Column:
    """Whole calendar days from a timestamp's date to ``day``."""
    return F.datediff(day, day_of(ts))
