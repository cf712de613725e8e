"""Means of doubles that don't depend on the order of the rows, rounded once.

A sum of doubles rounds at each step, so its last digits follow the partitioning. Here each
value is split at fixed powers of two into whole numbers of 28 bits, which are summed as longs:
exact, the same in any order, and open to taking values out again. The mean is a long division of
those sums by the number of values, rounded to a double at the very end, half to even.

Values below 2^56 in size are exact down to bits of 2^-112; smaller bits are rounded away value by
value, again in no order. Up to 2^34 values fit. Null counts as no value. A NaN, an infinity or
a larger value makes the mean NaN.

Values are given as SQL text, and a mean is one text that Spark parses at once: made of single
column calls, its build takes longer than many a report.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 28
LIMBS = 6
BASE = f"{2**BITS}L"
LARGEST = f"{2.0**56!r}D"
# Digits of the quotient: below the last limb, enough for 53 bits of the smallest mean.
DIGITS = LIMBS + 4

NO_DIGITS = "CAST(array() AS ARRAY<BIGINT>)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that is computed once, however often it is read."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def in_range(value: str) -> str:
    """Whether a value can be summed exactly; null for null."""
    return f"(abs({value}) < {LARGEST})"


def limbs(value: str) -> list[str]:
    """A value's parts, largest first, part i in units of 2^(28 - 28 i); 0 for out of range.

    Each is the difference of the value rounded to a grid and to the next coarser one, and all
    steps are exact in doubles.
    """
    x = f"CASE WHEN {in_range(value)} THEN {value} WHEN ({value}) IS NOT NULL THEN 0D END"
    grids = [f"rint(({x}) * {2.0 ** (BITS * (i - 1))!r}D)" for i in range(LIMBS)]
    finer = [f"{fine} - {coarse} * {float(2**BITS)!r}D" for coarse, fine in zip(grids, grids[1:])]
    return [f"CAST({part} AS BIGINT)" for part in [grids[0], *finer]]


def _carried(sums: str) -> str:
    """The same number with all parts but the first between 0 and 2^28."""
    return f"""aggregate(reverse({sums}),
        named_struct('carry', 0L, 'digits', {NO_DIGITS}, 'last', 0L),
        (done, part) -> named_struct(
            'carry', shiftright(part + done.carry, {BITS}),
            'digits', concat(array((part + done.carry) & ({BASE} - 1L)), done.digits),
            'last', part + done.carry),
        done -> concat(array(done.last), slice(done.digits, 2, {LIMBS})))"""


def _quotient(digits: str, n: str) -> str:
    """Digits of a division by n, and what remains."""
    here = f"(done.rest * {BASE} + digit)"
    return f"""aggregate(concat({digits}, array_repeat(0L, {DIGITS - LIMBS})),
        named_struct('digits', {NO_DIGITS}, 'rest', 0L),
        (done, digit) -> named_struct(
            'digits', concat(done.digits, array({here} div {n})), 'rest', {here} % {n}))"""


def _rounded(q: str) -> str:
    """The double nearest to the quotient of this name.

    Its leading digits become a whole number of 56 to 63 bits, whose last bit is set if anything
    follows. Turning that into a double is then the only rounding: the bit keeps what lies beside a
    tie from looking like one.
    """
    first, second, third = (f"coalesce(get({q}.digits, i + {j}), 0L)" for j in range(3))
    scale = f"CASE WHEN {first} < 64 THEN 28 WHEN {first} < 8192 THEN 21 WHEN {first} < 1048576 THEN 14 ELSE 7 END"
    whole = f"shiftleft({first} * {BASE} + {second}, s) + shiftright({third}, {BITS} - s)"
    follows = f"""({third} & (shiftleft(1L, {BITS} - s) - 1L)) > 0 OR {q}.rest > 0
        OR exists(slice({q}.digits, i + 4, {DIGITS}), d -> d > 0)"""
    nearest = f"CAST(({whole}) | CASE WHEN {follows} THEN 1L ELSE 0L END AS DOUBLE) * pow(2D, -{BITS} * i - s)"
    start = f"CAST(array_position(transform({q}.digits, d -> d > 0), true) AS INT) - 1"
    return _let("i", start, f"CASE WHEN i < 0 THEN 0D ELSE {_let('s', scale, nearest)} END")


def mean_of(sums: Sequence[str], n: str, out_of_range: str) -> Column:
    """The mean from the sums of ``limbs``, the number of values, and that of values out of range."""
    size = _let("q", _quotient("size", "counted"), _rounded("q"))
    below = _carried("transform(parts, p -> -p)")
    signed = f"CASE WHEN plain[0] < 0 THEN -{_let('size', below, size)} ELSE {_let('size', 'plain', size)} END"
    mean = _let("parts", f"array({', '.join(sums)})", _let("plain", _carried("parts"), signed))
    counted = _let("counted", n, f"CASE WHEN counted > 0 THEN {mean} END")
    return F.expr(f"CASE WHEN {out_of_range} > 0 THEN double('NaN') ELSE {counted} END")


def mean(value: str) -> Column:
    """Aggregate: the mean of the values that aren't null, null without any."""
    sums = [f"sum({part})" for part in limbs(value)]
    return mean_of(sums, f"count({value})", f"count_if(NOT {in_range(value)})")
