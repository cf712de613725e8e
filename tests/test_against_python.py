"""Column functions against plain Python on random input, one Spark job each."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

from fixtures import evaluate
from tallyreel.functions import figures, titles

CHARACTERS = list("aZ9 !?_-.'") + [
    "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​",
    "é", "ß", "٣", "９", "日", "🎉", "👍🏽", "́",
]


def random_titles(n=1500):
    rng = random.Random(11)
    return ["".join(rng.choices(CHARACTERS, k=rng.choice([0, 1, 3, 12, 40, 90]))) for _ in range(n)]


def test_title_functions(spark):
    texts = random_titles()
    pairs = [
        (titles.title_length, len),
        (titles.word_count, lambda t: len(t.split())),
        (titles.has_non_ascii, lambda t: not t.isascii()),
        (titles.has_digit, lambda t: re.search(r"\d", t) is not None),
        (titles.has_exclamation, lambda t: "!" in t),
        (titles.has_question, lambda t: "?" in t),
    ]
    for ours, plain in pairs:
        assert evaluate(spark, texts, ours) == [plain(t) for t in texts]


def one_decimal(x):
    """Nearest tenth to the exact binary value, ties upward."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def test_compact_numbers(spark):
    rng = random.Random(12)
    values = [rng.randint(1_000, 10 ** rng.randint(4, 11)) for _ in range(1500)]
    values += [50 * rng.randint(20, 20_000) for _ in range(1500)]  # many on a tie
    values += [50_000 * rng.randint(20, 20_000) for _ in range(1500)]
    expected = [
        one_decimal(v / 1_000_000) + "M" if v >= 1_000_000 else one_decimal(v / 1_000) + "K"
        for v in values
    ]
    assert evaluate(spark, values, figures.compact_number, "bigint") == expected


def test_display_names(spark):
    texts = [t.replace(" ", "_") for t in random_titles(600)]

    def plain(t):
        return re.sub(
            r"(?<![A-Za-z0-9_])[A-Za-z0-9_]", lambda m: m[0].upper(), t.replace("_", " ")
        )

    assert evaluate(spark, texts, figures.display_name) == [plain(t) for t in texts]


def test_durations(spark):
    rng = random.Random(13)
    texts, expected, with_days = [], [], []
    for _ in range(800):
        d, h, m, s = (rng.choice([None, rng.randint(0, 99)]) for _ in range(4))
        days = "" if d is None else f"{d}D"
        times = "".join(f"{n}{u}" for n, u in [(h, "H"), (m, "M"), (s, "S")] if n is not None)
        with_time = rng.random() < 0.9
        texts.append(f"P{days}" + (f"T{times}" if with_time else ""))
        total = (h or 0) * 3600 + (m or 0) * 60 + (s or 0) if with_time else 0
        expected.append(total)
        with_days.append(total + (d or 0) * 86_400 if with_time else 0)
    assert evaluate(spark, texts, figures.duration_seconds) == expected
    counted = evaluate(spark, texts, lambda c: figures.duration_seconds(c, count_days=True))
    assert counted == with_days
