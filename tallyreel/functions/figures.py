"""Number handling: rounding, classes, durations and display text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyreel.schemas import CLASS_BOUNDS, CLASS_LABELS, label_for

# Fixed pattern: ISO 8601 duration, read from the start of the text.
DURATION = r"^P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
SHORT_MAX_SECONDS = 60


def whole(value: Column) -> Column:
    """Integer part, toward zero."""
    return value.cast("bigint")


def ratio(part: Column, total: Column) -> Column:
    """Double quotient; null instead of an error when the divisor is zero."""
    return part.cast("double") / F.nullif(total, F.lit(0).cast("bigint")).cast("double")


def performance_class(views: Column) -> Column:
    """Class 0 to 3 by view count; each bound belongs to the upper class."""
    number = F.lit(0)
    for position, bound in enumerate(CLASS_BOUNDS, start=1):
        number = F.when(views >= bound, F.lit(position)).otherwise(number)
    return F.when(views.isNotNull(), number).cast("bigint")


def class_label(number: Column) -> Column:
    return label_for(CLASS_LABELS, number)


def duration_seconds(text: Column, count_days: bool = False) -> Column:
    """Seconds in an ISO duration, 0 when it does not match.

    The day part is matched but adds nothing unless ``count_days`` is set.
    """
    weights = {1: 86_400 if count_days else 0, 2: 3_600, 3: 60, 4: 1}
    total = F.lit(0).cast("bigint")
    for group, seconds in weights.items():
        if seconds:
            part = F.regexp_extract(text, DURATION, group).try_cast("bigint")
            total = total + F.coalesce(part, F.lit(0)) * F.lit(seconds)
    return total


def short_flag(seconds: Column) -> Column:
    return F.when(seconds <= SHORT_MAX_SECONDS, F.lit(1)).otherwise(F.lit(0))


def _one_decimal(x: Column) -> Column:
    """Text with one decimal, nearest to the exact binary value, ties upward.

    20x - (2k + 1) decides between k and k + 1 tenths. Near the tie both
    subtractions are exact in binary, so the sign is the true one.
    """
    tenths = F.floor(x * 10)
    middle = (tenths * 2 + 1).cast("double")
    tenths = tenths + F.when((x * 16 - middle) + x * 4 >= 0, 1).otherwise(0)
    return F.concat(
        F.floor(tenths / 10).cast("bigint").cast("string"),
        F.lit("."),
        F.pmod(tenths, F.lit(10)).cast("string"),
    )


def compact_number(value: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K, small values as whole numbers, null as a dash."""
    x = value.cast("double")
    return (
        F.when(x.isNull(), F.lit("—"))
        .when(x >= 1_000_000, F.concat(_one_decimal(x / 1_000_000), F.lit("M")))
        .when(x >= 1_000, F.concat(_one_decimal(x / 1_000), F.lit("K")))
        .otherwise(F.floor(x + 0.5).cast("bigint").cast("string"))
    )


def display_name(name: Column) -> Column:
    """Underscores to spaces and each word's first character in upper case.

    The text is cut before every ASCII word start; the rest of a word keeps its case.
    """
    pieces = F.split(F.replace(name, F.lit("_"), F.lit(" ")), r"(?<!\w)(?=\w)")
    raised = F.transform(
        pieces,
        lambda piece: F.when(
            piece.rlike(r"^\w"),
            F.concat(F.upper(F.substring(piece, 1, 1)), F.substring(piece, 2, 2_147_483_647)),
        ).otherwise(piece),
    )
    return F.array_join(raised, "")
