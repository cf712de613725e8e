"""Stored reply texts: normalising them to JSON objects and finding the live ones."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.operators.upserts import latest_by_key, upsert

LIVE_HOURS = 24
# Error texts, and how much of a bad reply is kept with them.
UNREADABLE = "Could not parse AI response"
NOT_AN_OBJECT = "AI response was valid JSON, but not a JSON object"
KEPT_CHARS = 500

# The characters that count as white space around a reply.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The opening fence line up to its line break, and a closing fence line at the end.
OPENING_FENCE = r"^```[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*([\x1C-\x1E]|\R|$)"
CLOSING_FENCE = r"(^|[\x1C-\x1E]|\R)[^\S\n\r]*```$"


def reply_body(text: Column) -> Column:
    """The text without its code fence lines and without a leading ``json`` word."""
    space = F.lit(WHITE_SPACE)
    clean = F.trim(text, space)
    unfenced = F.regexp_replace(F.regexp_replace(clean, OPENING_FENCE, ""), CLOSING_FENCE, "")
    body = F.when(clean.startswith("```"), F.trim(unfenced, space)).otherwise(clean)
    rest = F.ltrim(F.substring(body, 5, 2_147_483_647), space)
    return F.when(F.lower(F.substring(body, 1, 4)) == "json", rest).otherwise(body)


def normalise(replies: DataFrame) -> DataFrame:
    """Add the reply as a JSON object, or an error with the start of the raw text.

    The parser alone ignores what follows the first value. A text is one whole value
    exactly when it parses as the only element of an array and does not close that
    array itself, which a text without ``]`` cannot do and any other text shows by
    also parsing as a field of an object.
    """
    body = F.col("_body")
    as_array = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    alone = F.size("_elements") == 1
    closed = F.when(body.contains("]"), as_field.isNotNull()).otherwise(F.lit(True))
    parsed = (
        replies.withColumn("_body", reply_body(F.col("response")))
        .withColumn("_elements", as_array.cast("array<variant>"))
        .withColumn("_readable", F.coalesce(F.when(alone, closed), F.lit(False)))
        .withColumn("_object", F.col("_readable") & body.startswith("{"))
    )
    return parsed.select(
        *replies.columns,
        F.when(F.col("_object"), F.to_json(F.col("_elements")[0])).alias("reply"),
        F.when(~F.col("_readable"), F.lit(UNREADABLE))
        .when(~F.col("_object"), F.lit(NOT_AN_OBJECT))
        .alias("error"),
        F.when(~F.col("_object"), F.substring("response", 1, KEPT_CHARS)).alias("raw"),
    )


def upsert_replies(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Stored replies with newer ones replacing those of the same key."""
    return upsert(stored, incoming, ["cache_key"], "created_at")


def live(
    replies: DataFrame, as_of: dt.datetime, hours: int = LIVE_HOURS, keep_errors: bool = False
) -> DataFrame:
    """The latest reply per key when it is not older than the limit.

    A key's latest reply is fresh exactly when it has a fresh one, so old replies are left
    out first, at the scan, and only fresh ones are shuffled. Replies that could not be
    read are left out unless asked for.
    """
    oldest = F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz")
    checked = normalise(latest_by_key(replies.filter(F.col("created_at") >= oldest), ["cache_key"], "created_at"))
    kept = checked if keep_errors else checked.filter(F.col("error").isNull())
    return kept.select("cache_key", "reply", "created_at")


def with_replies(fingerprints: DataFrame, live_replies: DataFrame) -> DataFrame:
    """Contexts next to the live reply to the same statistics, if there is one."""
    found = live_replies.select("cache_key", "reply")
    return fingerprints.join(found, "cache_key", "left").withColumn(
        "from_cache", F.col("reply").isNotNull()
    )
