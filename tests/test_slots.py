import random

import pytest
from pyspark.sql import functions as F

from tallyreel.plans import forecast, slots
from tallyreel.schemas import FEATURES


def rows(spark, n, classes=(0, 1, 2, 3), seed=5):
    """Classes follow hour, weekday and title length together, with noise."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        hour, day, length = rng.randrange(24), rng.randrange(7), rng.randrange(60)
        c = classes[(hour // 8 + day // 3 + length // 20 + (rng.random() < 0.2)) % len(classes)]
        made = {"hour": hour, "day_of_week": day, "title_length": length}
        data.append((i, *[made.get(f, rng.randint(0, 1)) for f in FEATURES], c))
    return spark.createDataFrame(data, f"id long, {', '.join(f'{f} bigint' for f in FEATURES)}, category bigint")


def expanded(spark, model, titles):
    """Every title in every slot, scored as rows."""
    week = spark.range(7).toDF("day_of_week").crossJoin(spark.range(24).toDF("hour"))
    scored = slots.boosting.score(titles.drop(*slots.WEEK).crossJoin(week), model.booster, FEATURES)
    found = {}
    for r in scored.select("rest.id", "rest.day_of_week", "rest.hour", "chances").collect():
        expected = sum(c * p for c, p in zip(model.classes, r["chances"], strict=True))
        found.setdefault(r["id"], []).append((-round(expected, 9), r["day_of_week"], r["hour"]))
    return {i: sorted(s) for i, s in found.items()}


@pytest.mark.parametrize("classes", [(0, 1, 2, 3), (1, 3), (2,)])
def test_best_slots_are_those_of_the_expanded_table(spark, classes):
    model = forecast.fit(rows(spark, 400, classes), max_iter=8)
    few = rows(spark, 23, classes, seed=6).drop("category")
    missing = few.limit(1).withColumns({"id": F.lit(99).cast("long"), "title_length": F.lit(None).cast("long")})
    titles = few.unionByName(missing).unionByName(few.limit(3).withColumn("id", F.col("id") + 200))
    titles = titles.withColumn("slot_", F.lit("kept"))
    wanted = expanded(spark, model, titles)
    found = slots.best_slots(model, titles.drop(*slots.WEEK)).collect()
    assert len(found) == len(wanted) == 27
    for r in found:
        # Sums in another order may differ in the last digits, so a slot may only tie with the first one.
        value = {(d, h): -e for e, d, h in wanted[r["id"]]}
        best = -wanted[r["id"]][0][0]
        assert r["expected_class"] == pytest.approx(best, abs=2e-9)
        assert value[r["slot"]["day_of_week"], r["slot"]["hour"]] == pytest.approx(best, abs=2e-9)
        assert r["slot_"] == "kept" and r["predicted_class"] in classes
    if len(classes) == 1:
        assert {(r["slot"]["day_of_week"], r["slot"]["hour"]) for r in found} == {(0, 0)}
    assert slots.best_slots(model, titles.drop(*slots.WEEK).limit(0)).collect() == []
