"""Means rounded once, against exact fractions, and under any order of the rows."""

import math
import random
from fractions import Fraction

import pytest

from tallyreel.functions import exact
from tallyreel.operators import engagement, totals


def true_mean(values):
    return float(sum(map(Fraction, values)) / len(values))


def groups():
    rng = random.Random(5)
    yield [0.1] * 3
    yield [0.1] * 10 + [0.2] * 10 + [0.3] * 10
    yield [0.0, -0.0]
    yield [1e15, 0.1, -1e15]
    yield [-0.3, 0.1, 0.1]
    yield [2.0**55, 2.0**-50, -(2.0**55)]
    yield [2.0**56 - 8, 1.0]
    yield [1.0, 2.0**-53, 2.0**-105]
    yield [1.0 + 2.0**-52, 1.0]
    yield [2.0**-58, 0.0, 0.0]
    for size in (1, 2, 3, 7, 1000):
        yield [rng.random() * 100 for _ in range(size)]
        yield [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 15) for _ in range(size)]
        yield [rng.randrange(10_000) / 100 for _ in range(size)]
    for _ in range(150):
        # Near ties of the last bit: whole numbers of 54 bits and more over small counts.
        yield [float(rng.randrange(2**52, 2**53)) for _ in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_mean_is_the_nearest_double(spark, parts):
    given = list(groups())
    rows = [(g, x) for g, values in enumerate(given) for x in values]
    random.Random(parts).shuffle(rows)
    frame = spark.createDataFrame(rows, "g int, x double").repartition(parts)
    found = {r["g"]: r["m"] for r in frame.groupBy("g").agg(exact.mean("x").alias("m")).collect()}
    assert found == {g: true_mean(values) for g, values in enumerate(given)}


def test_nulls_empty_groups_and_what_cannot_be_summed(spark):
    rows = [("null", None), ("some", None), ("some", 2.5), ("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("big", 1e300)]
    frame = spark.createDataFrame(rows, "g string, x double")
    found = {r["g"]: r["m"] for r in frame.groupBy("g").agg(exact.mean("x").alias("m")).collect()}
    assert found["null"] is None and found["some"] == 2.5
    assert all(math.isnan(found[g]) for g in ("nan", "inf", "big"))
    assert frame.limit(0).agg(exact.mean("x").alias("m")).first()["m"] is None


def test_values_taken_out_again(spark):
    """Limbs of removed rows count negative, as kept reports have them."""
    frame = spark.createDataFrame([(1, 0.1), (1, 1e15), (1, 0.7), (-1, 1e15)], "s int, x double")
    sums = [f"sum({part} * s)" for part in exact.limbs("x")]
    found = frame.agg(exact.mean_of(sums, "sum(s)", "0").alias("m")).first()["m"]
    assert found == true_mean([0.1, 0.7])


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_equal_retention_is_never_under_the_mean(spark, parts):
    """Equal videos equal their mean to the last bit; a difference of the last bit counts."""
    days = [(f"v{v}", day, 500, 33.1 + (v % 3) / 10, 0, 0) for v in range(40) for day in range(7)]
    less = [("w", day, 500, math.nextafter(33.1, 0), 0, 0) for day in range(7)]
    schema = "video_id string, day int, views bigint, average_view_percentage double, subscribers_gained bigint, subscribers_lost bigint"
    videos = spark.createDataFrame([(f"v{v}", f"c{v % 3}", "t") for v in range(40)] + [("w", "c0", "t")], "video_id string, channel_id string, title string")

    def under(rows):
        daily = spark.createDataFrame(rows, schema).repartition(parts)
        engaged = engagement.engagement_by_video(videos, daily, ["channel_id"])
        return {r["video_id"] for r in engagement.below_baseline(engaged, ["channel_id"]).collect()}

    assert under(days) == set()
    assert under(days + less) == {"w"}
    facts = totals.video_facts(spark.createDataFrame(days, schema).repartition(parts))
    assert {r["avg_retention"] for r in facts.collect()} == {33.1, 33.1 + 0.1, 33.1 + 0.2}
