"""Title features. A null title gives null features."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyreel.schemas import LENGTH_BOUNDS, LENGTH_BUCKETS, label_for

# Fixed patterns. The first counts any character outside ASCII, so accents count
# too; the second accepts decimal digits of every script; the third is a run of
# characters that are not Unicode white space or the four separator controls.
NON_ASCII = r"[^\x00-\x7F]"
ANY_DIGIT = r"\p{Nd}"
WORD = r"(?U)[^\s\x1C-\x1F]+"


def has_non_ascii(title: Column) -> Column:
    return title.rlike(NON_ASCII)


def has_exclamation(title: Column) -> Column:
    return title.contains("!")


def has_question(title: Column) -> Column:
    return title.contains("?")


def has_digit(title: Column) -> Column:
    return title.rlike(ANY_DIGIT)


def title_length(title: Column) -> Column:
    return F.length(title).cast("bigint")


def word_count(title: Column) -> Column:
    return F.regexp_count(title, F.lit(WORD)).cast("bigint")


def length_bucket_number(title: Column) -> Column:
    """0 to 3, null for an empty title and for one longer than the last bound."""
    size, number = F.length(title), F.lit(None)
    for position in reversed(range(len(LENGTH_BOUNDS))):
        number = F.when(size <= LENGTH_BOUNDS[position], F.lit(position)).otherwise(number)
    return F.when(size > 0, number).cast("bigint")


def length_bucket_name(number: Column) -> Column:
    return label_for(LENGTH_BUCKETS, number)
