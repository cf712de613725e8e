"""JSON text as a column, with keys sorted at every depth."""

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that JSON names by a letter; other control characters go by number.
LETTERS = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def string(value: Column) -> Column:
    """A quoted string; characters beyond ASCII stay as they are."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = [chr(i) for i in range(32)]
    named = functools.reduce(
        lambda c, x: F.replace(c, F.lit(x), F.lit(LETTERS.get(x, f"\\u{ord(x):04x}"))), controls, plain
    )
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), named).otherwise(plain), F.lit('"'))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _shortest(value: Column) -> Column:
    """The fewest digits that read back as the same number, in the form 1.5e+03."""

    def first(lengths):
        tried = [F.format_string(f"%.{n}e", value) for n in lengths]
        return F.coalesce(*[F.when(t.cast("double") == value, t) for t in tried], F.lower(value.cast("string")))

    # Below the least normal number, fewer digits than fifteen may already be ambiguous.
    return F.when(value < 2.3e-308, first(range(17))).otherwise(first((14, 15, 16)))


def _digits(scientific: Column) -> Column:
    """Significant digits, and how many of them stand before the point."""
    mantissa = F.substring_index(scientific, "e", 1)
    power = F.coalesce(F.try_element_at(F.split(scientific, "e"), F.lit(2)).cast("int"), F.lit(0))
    known = F.struct(
        F.replace(mantissa, F.lit("."), F.lit("")).alias("all"),
        (F.length(F.substring_index(mantissa, ".", 1)) + power).alias("point"),
    )
    return _let(
        known,
        lambda k: F.struct(
            F.trim(k["all"], F.lit("0")).alias("digits"),
            (k["point"] - F.length(k["all"]) + F.length(F.ltrim(k["all"], F.lit("0")))).alias("point"),
        ),
    )


def _written(number: Column) -> Column:
    digits, point = number["digits"], number["point"]
    size, power = F.length(digits), F.abs(point - 1).cast("string")
    fixed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size), F.lit(".0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    scientific = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
        F.when(point > 0, "e+").otherwise("e-"),
        F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
    )
    return F.when(point.between(-3, 16), fixed).otherwise(scientific)


def number(value: Column) -> Column:
    """A double: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""

    def text(x):
        plain = F.when(x == 0, "0.0").otherwise(_let(_digits(_shortest(F.abs(x))), _written))
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        special = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(special, x.cast("string")).otherwise(F.concat(sign, plain))

    return _let(value.cast("double"), text)


def json_object(members: dict[str, Column]) -> Column:
    """An object of values that are JSON already."""
    parts = [F.concat(string(F.lit(n)), F.lit(": "), members[n]) for n in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _key(key: Column, kind: T.DataType) -> Column:
    return string(key) if isinstance(kind, T.StringType) else F.concat(F.lit('"'), json(key, kind), F.lit('"'))


def json(value: Column, kind: T.DataType) -> Column:
    """JSON of a value of any nested type: ", " and ": " between parts, names and map keys in order.

    Null is null, a number that is none is NaN. Dates and times are strings.
    """
    if isinstance(kind, T.StructType):
        text = json_object({f.name: json(value[f.name], f.dataType) for f in kind.fields})
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: json(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        # Keys are unique, so the order never falls to the values, which need not be sortable.
        keys = F.array_sort(F.map_keys(value))
        members = F.transform(
            keys,
            lambda k: F.concat(_key(k, kind.keyType), F.lit(": "), json(F.element_at(value, k), kind.valueType)),
        )
        text = F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))
    elif isinstance(kind, T.FractionalType):
        text = number(value)
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        text = value.cast("string")
    else:
        text = string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)
