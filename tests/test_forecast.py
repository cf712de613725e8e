import collections
import random

import pytest

from tallyreel.plans import forecast
from tallyreel.schemas import CLASS_LABELS, FEATURES
from tallyreel.sources import store


def rows(spark, n, classes=(0, 1, 2, 3), seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        c = classes[i % len(classes)]
        # The hour follows the class, so the classes can be learned.
        data.append((f"v{i}", 6 * c + rng.randint(0, 5), *[rng.randint(0, 1) for _ in FEATURES[1:]], c))
    names = ", ".join(f"{f} bigint" for f in FEATURES)
    return spark.createDataFrame(data, f"video_id string, {names}, category bigint")


@pytest.fixture(scope="module")
def fitted(spark):
    return forecast.fit(rows(spark, 120), max_iter=2)


@pytest.mark.parametrize("parts", [1, 7])
def test_folds_deal_each_class_evenly(spark, parts):
    data = rows(spark, 203, classes=(0, 0, 0, 0, 1, 2)).repartition(parts)
    dealt = forecast.folds(data).collect()
    assert sorted(r["video_id"] for r in dealt) == sorted(f"v{i}" for i in range(203))
    by_class = collections.defaultdict(list)
    for r in dealt:
        by_class[r["category"]].append(r)
    for members in by_class.values():
        order = sorted(members, key=lambda r: r["video_id"])
        assert [r["fold"] for r in order] == [i % 5 for i in range(len(order))]


def test_fit_learns_and_scores(spark, fitted):
    scored = forecast.predict(fitted, rows(spark, 120, seed=9)).collect()
    assert sum(r["predicted_class"] == r["category"] for r in scored) > 100
    for r in scored:
        assert r["predicted_category"] == CLASS_LABELS[r["predicted_class"]]
        assert abs(sum(r["probabilities"].values()) - 100) < 0.3
        assert r["probabilities"][r["predicted_category"]] == max(r["probabilities"].values())


def test_importance_sums_to_one(spark, fitted):
    weights = {r["feature"]: r["importance"] for r in forecast.importance(spark, fitted).collect()}
    assert list(weights) == FEATURES
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert max(weights, key=weights.get) == "hour"
    chart = forecast.importance_chart(forecast.importance(spark, fitted)).collect()
    assert chart[0]["feature"] == "Hour"
    assert [r["value"] for r in chart] == sorted((r["value"] for r in chart), reverse=True)


@pytest.mark.parametrize("classes", [(0, 1, 3), (0, 1, 2)])
def test_a_class_not_seen_gets_no_chance(spark, classes):
    model = forecast.fit(rows(spark, 60, classes=classes), max_iter=2)
    assert model.classes == classes
    missing = CLASS_LABELS[({0, 1, 2, 3} - set(classes)).pop()]
    scored = forecast.predict(model, rows(spark, 20, classes=classes)).collect()
    assert {r["probabilities"][missing] for r in scored} == {0.0}
    assert {r["predicted_class"] for r in scored} <= set(classes)


def test_saved_model_scores_the_same(spark, fitted):
    path = store.fresh_folder(spark, "model")
    fitted.save(spark, path)
    again = forecast.Forecaster.load(spark, path)
    data = rows(spark, 30, seed=4)
    assert again.trained_on == fitted.trained_on == 120
    one, two = (
        sorted((r["video_id"], r["predicted_class"]) for r in forecast.predict(m, data).collect())
        for m in (fitted, again)
    )
    assert one == two


def test_a_model_is_fitted_once_for_equal_rows(spark, monkeypatch):
    data = rows(spark, 50, seed=11)
    first = forecast.kept_fit(data, max_iter=2)
    fit, fits = forecast.boosting.fit, []
    monkeypatch.setattr(forecast.boosting, "fit", lambda *a: fits.append(a) or fit(*a))
    again = forecast.kept_fit(data.repartition(5), max_iter=2)
    assert fits == [] and again.trained_on == first.trained_on == 50
    assert forecast.boosting.tree_rows(again.booster) == forecast.boosting.tree_rows(first.booster)
    forecast.kept_fit(data, max_iter=3)
    forecast.kept_fit(data.limit(49), max_iter=2)
    assert len(fits) == 2


def test_metrics_row(spark):
    row = forecast.metrics(rows(spark, 100), k=2, max_iter=1).first()
    assert row["trained_on"] == 100
    assert sum(row["distribution"].values()) == 100
    assert 0.5 < row["accuracy"] <= 1
    assert set(row["feature_importance"]) == set(FEATURES)


def test_predictions_of_unseen_rows_beat_the_majority(spark):
    data = rows(spark, 160, classes=(0, 0, 1, 2, 3))
    out = forecast.accuracy(forecast.cross_predictions(data, k=2, max_iter=5)).first()["accuracy"]
    assert out > 0.6  # the most frequent class alone would give 0.4


def test_a_group_without_videos_gets_the_overall_slot(spark):
    titles = spark.createDataFrame([("k", "one"), ("new", "two")], "channel_id string, title string")
    slots = spark.createDataFrame([("k", 7, "Monday")], "channel_id string, best_hour bigint, best_day string")
    overall = spark.createDataFrame([(9, "Friday")], "best_hour bigint, best_day string")
    found = forecast.slot_features(titles, slots, 2, ["channel_id"], overall).collect()
    got = {r["channel_id"]: (r["hour"], r["day_of_week"]) for r in found}
    assert got == {"k": (7, 0), "new": (9, 4)}
    alone = forecast.slot_features(titles, overall, 2, [], overall).collect()
    assert [(r["hour"], r["day_of_week"]) for r in alone] == [(9, 4)] * 2


def test_equal_rows_train_as_one_weighted_row(spark):
    data = rows(spark, 40)
    tripled = data.union(data).union(data)
    one, three = (forecast.fit(x, max_iter=2) for x in (data, tripled))
    assert three.trained_on == 120
    scores = [
        sorted((r["video_id"], r["predicted_class"]) for r in forecast.predict(m, data).collect())
        for m in (one, three)
    ]
    assert scores[0] == scores[1]
