"""The fitted forecast queries against plain Python on the whole training rows of a small folder."""

import collections

import pytest
from plain_boosting import Plain

import __spark_entry__ as entry
from tallyreel.plans import boosting, forecast
from tallyreel.schemas import CLASS_LABELS, FEATURES

FOLDER = "/root/testdata/sf0.001"
TREES = 12
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def few_trees():
    """The queries with fewer trees, so that plain Python can follow."""
    patch = pytest.MonkeyPatch()
    for module, name in ((forecast, "fit"), (forecast, "kept_fit"), (forecast, "cross_predictions"), (forecast, "metrics")):
        function = getattr(module, name)
        defaults = tuple(TREES if d == boosting.TREES else d for d in function.__defaults__)
        patch.setattr(function, "__defaults__", defaults)
    yield
    patch.undo()


def collected(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]


@pytest.fixture(scope="module")
def training(spark):
    folds = {r["video_id"]: r["fold"] for r in collected(spark, "ml_folds")}
    return [(r["video_id"], tuple(r[f] for f in FEATURES), r["category"], folds[r["video_id"]]) for r in collected(spark, "ml_features")]


@pytest.fixture(scope="module")
def plain(training):
    return Plain([x for _, x, _, _ in training], [c for _, _, c, _ in training], TREES, 4)


def percents(model, x):
    chances = dict(zip(model.classes, model.chances(x)))
    return {label: 100 * chances.get(c, 0.0) for c, label in enumerate(CLASS_LABELS)}


def test_predictions_and_importance(spark, few_trees, plain):
    candidates = {r["doc_id"]: tuple(r[f] for f in FEATURES) for r in collected(spark, "candidate_features")}
    found = collected(spark, "ml_predict")
    assert len(found) == len(candidates) > 0
    for r in found:
        want = percents(plain, candidates[r["doc_id"]])
        assert r["probabilities"] == pytest.approx(want, abs=0.0501)
        top = max(want.values())
        assert want[r["predicted_category"]] == pytest.approx(top, abs=1e-6)
        assert CLASS_LABELS[r["predicted_class"]] == r["predicted_category"]
    importance = {r["feature"]: r["importance"] for r in collected(spark, "ml_importance")}
    assert list(importance) == FEATURES
    assert list(importance.values()) == pytest.approx(plain.importance(len(FEATURES)), abs=1e-9)
    chart = collected(spark, "chart_importance")
    assert sorted(r["value"] for r in chart) == pytest.approx(sorted(100 * v for v in importance.values()), abs=0.0501)
    assert [r["value"] for r in chart] == sorted((r["value"] for r in chart), reverse=True)


def test_best_slots(spark, few_trees, plain):
    """The highest expected class over all hours and weekdays, tried one by one."""
    candidates = {r["doc_id"]: tuple(r[f] for f in FEATURES) for r in collected(spark, "candidate_features")}
    found = collected(spark, "ml_best_slots")
    assert sorted(r["doc_id"] for r in found) == sorted(candidates)
    hour, day = FEATURES.index("hour"), FEATURES.index("day_of_week")
    for r in found[:8]:
        tried = {}
        for slot in [(d, h) for d in range(7) for h in range(24)]:
            x = list(candidates[r["doc_id"]])
            x[day], x[hour] = slot
            tried[slot] = sum(c * p for c, p in zip(plain.classes, plain.chances(tuple(x))))
        assert r["expected_class"] == pytest.approx(max(tried.values()), abs=1e-6)
        assert tried[r["day_of_week"], r["hour"]] == pytest.approx(max(tried.values()), abs=1e-6)


def test_predictions_of_held_out_folds(spark, few_trees, training):
    found = {r["video_id"]: r for r in collected(spark, "ml_cv_predictions")}
    assert len(found) == len(training)
    right = 0
    for fold in range(5):
        own = [(x, c) for _, x, c, f in training if f != fold]
        model = Plain([x for x, _ in own], [c for _, c in own], TREES, 4)
        for video, x, c, f in training:
            if f == fold:
                chances = dict(zip(model.classes, model.chances(x)))
                assert (found[video]["fold"], found[video]["category"]) == (f, c)
                assert chances[found[video]["predicted_class"]] == pytest.approx(max(chances.values()), abs=1e-9)
                right += found[video]["predicted_class"] == c
    assert collected(spark, "ml_cv_accuracy") == [{"accuracy": pytest.approx(right / len(training))}]


def test_metrics(spark, few_trees, training, plain):
    (row,) = collected(spark, "ml_metrics")
    counts = collections.Counter(c for _, _, c, _ in training)
    assert row["trained_on"] == len(training)
    assert row["distribution"] == {label: counts[c] for c, label in enumerate(CLASS_LABELS)}
    assert row["accuracy"] == collected(spark, "ml_cv_accuracy")[0]["accuracy"]
    want = dict(zip(FEATURES, plain.importance(len(FEATURES))))
    assert row["feature_importance"] == pytest.approx(want, abs=1e-9)
