import datetime as dt

import pytest

from fixtures import evaluate
from tallyreel.functions import clock, figures, titles


def test_length_buckets(spark):
    sizes = [0, 1, 30, 31, 50, 51, 70, 71, 200, 201]
    got = evaluate(
        spark,
        ["x" * n for n in sizes],
        lambda c: titles.length_bucket_name(titles.length_bucket_number(c)),
    )
    assert got == [
        None, "short", "short", "medium", "medium", "long", "long", "very_long", "very_long", None,
    ]


def test_title_marks(spark):
    texts = ["naïve", "plain", "fun 🎉", "really?", "wow!", "x–y", "top 10", "٣ tips", None]
    assert evaluate(spark, texts, titles.has_non_ascii) == [
        True, False, True, False, False, True, False, True, None,
    ]
    assert evaluate(spark, texts, titles.has_question)[3] is True
    assert evaluate(spark, texts, titles.has_exclamation)[4] is True
    assert evaluate(spark, texts, titles.has_digit)[6:] == [True, True, None]


def test_words_are_runs_between_white_space(spark):
    texts = ["", "   ", "a  b", "a b", " one\ttwo\nthree ", "a\x1fb", "wörd", "a b c", None]
    expected = [None if t is None else len(t.split()) for t in texts]
    assert evaluate(spark, texts, titles.word_count) == expected


def test_length_counts_code_points(spark):
    texts = ["🎉🎉", "é", "é"]
    assert evaluate(spark, texts, titles.title_length) == [len(t) for t in texts]


def test_view_classes(spark):
    views = [0, 9_999, 10_000, 99_999, 100_000, 999_999, 1_000_000, None]
    got = evaluate(spark, views, figures.performance_class, "bigint")
    assert got == [0, 0, 1, 1, 2, 2, 3, None]


def test_durations(spark):
    texts = ["PT45S", "PT1M30S", "PT1H", "P1DT2H", "P0D", "PT", "PT60S", "PT61S", "", "xPT5S", "PT5M?"]
    assert evaluate(spark, texts, figures.duration_seconds) == [
        45, 90, 3600, 7200, 0, 0, 60, 61, 0, 0, 300,
    ]
    with_days = evaluate(spark, texts, lambda c: figures.duration_seconds(c, count_days=True))
    assert with_days[3] == 93_600
    short = evaluate(spark, texts, lambda c: figures.short_flag(figures.duration_seconds(c)))
    assert short == [1, 0, 0, 0, 1, 1, 1, 0, 1, 1, 0]


def test_compact_numbers(spark):
    values = [0, 7, 999, 1_000, 1_250, 1_350, 1_450, 999_949, 1_000_000, 1_234_567, 36_000_000, None]
    # 1.35 is stored above and 1.45 below the tie; 1.25 is exact and goes up.
    assert evaluate(spark, values, figures.compact_number, "bigint") == [
        "0", "7", "999", "1.0K", "1.3K", "1.4K", "1.4K", "999.9K", "1.0M", "1.2M", "36.0M", "—",
    ]


def test_compact_number_rounds_small_halves_up(spark):
    assert evaluate(spark, [0.5, 1.5, 2.4], figures.compact_number, "double") == ["1", "2", "2"]


def test_display_names(spark):
    names = ["YT_SEARCH", "day_of_week", "ext-url x", "subscriber", "né fini", "", "o'neil"]
    assert evaluate(spark, names, figures.display_name) == [
        "YT SEARCH", "Day Of Week", "Ext-Url X", "Subscriber", "Né Fini", "", "O'Neil",
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_parsed_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = [
            "2024-03-10T02:30:00Z", "2024-01-01T00:30:00+02:00", "1999-12-31T23:59:59.25Z", "soon",
            "2024-03-10T02:30:00", "2024-03-10 02:30:00.5", "2024-03-10", None,
        ]
        assert evaluate(spark, texts, clock.utc_wall_clock) == [
            dt.datetime(2024, 3, 10, 2, 30),
            dt.datetime(2023, 12, 31, 22, 30),
            dt.datetime(1999, 12, 31, 23, 59, 59, 250_000),
            None,
            # Without an offset a text is UTC.
            dt.datetime(2024, 3, 10, 2, 30),
            dt.datetime(2024, 3, 10, 2, 30, 0, 500_000),
            dt.datetime(2024, 3, 10),
            None,
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_weekdays_start_on_monday(spark):
    days = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    assert evaluate(spark, days, clock.weekday_number, "timestamp_ntz") == list(range(7))
    names = evaluate(
        spark, days, lambda c: clock.weekday_name(clock.weekday_number(c)), "timestamp_ntz"
    )
    assert names == [d.strftime("%A") for d in days]


def test_rounding_to_even(spark):
    from pyspark.sql import functions as F

    values = [2.25, 0.15, 2.35, 86.25]
    assert evaluate(spark, values, lambda c: F.bround(c, 1), "double") == [2.2, 0.2, 2.4, 86.2]
