"""The multinomial booster against plain Python, in one task and spread over many."""

import random

import numpy as np
import pytest
from plain_boosting import Plain

from tallyreel.plans import boosting

FEATURES = ["p", "q", "r"]


def some_rows(n, classes, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = (rng.randrange(24), rng.randrange(-3, 4), rng.randrange(2))
        rows.append((x, classes[(x[0] // 5 + 2 * x[1] * x[2] + rng.randrange(2)) % len(classes)]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, c) for x, c in rows], "p long, q int, r long, category long")


def fitted(spark, rows, trees, depth):
    return boosting.fit(boosting.points_of(frame(spark, rows), FEATURES), FEATURES, trees, depth)


@pytest.mark.parametrize("classes", [(0, 1, 2, 3), (0, 2, 3), (1, 3)])
def test_chances_and_importance_equal_plain_ones(spark, classes):
    rows = some_rows(90, classes)
    rows += rows[:30]  # repeated rows count as often as they come
    own, plain = fitted(spark, rows, 12, 3), Plain([x for x, _ in rows], [c for _, c in rows], 12, 3)
    asked = [x for x, _ in some_rows(60, classes, 2)]
    found = boosting.score(spark.createDataFrame(asked, "p long, q long, r long"), own, FEATURES).collect()
    assert own.classes == classes and len(own.rounds) == 12
    got = {tuple(r["rest"]): r["chances"] for r in found}
    for x in asked:
        assert got[x] == pytest.approx(plain.chances(x), abs=1e-9)
    assert own.importance(3) == pytest.approx(plain.importance(3), abs=1e-9)


def test_spread_rows_give_the_same_trees(spark, monkeypatch):
    rows = some_rows(400, (0, 1, 2))
    alone = boosting.tree_rows(fitted(spark, rows, 5, 3))
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(boosting, "SETTLED_ROUNDS", 2)
    assert boosting.tree_rows(fitted(spark, rows, 5, 3)) == alone
    random.Random(1).shuffle(rows)
    assert boosting.tree_rows(fitted(spark, rows, 5, 3)) == alone


def test_spread_rows_send_the_driver_one_row_a_node(spark, monkeypatch):
    kind, sent = type(spark.range(1)), []
    plain = kind.toArrow

    def counted(frame):
        table = plain(frame)
        sent.append(table.num_rows)
        return table

    monkeypatch.setattr(kind, "toArrow", counted)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 40)
    fitted(spark, some_rows(400, (0, 1, 2)), 2, 3)
    # At most 1, 2 and 4 open nodes of each class, not each one's bins.
    assert len(sent) == 6 and all(n <= 3 * 2**level for n, level in zip(sent, (0, 1, 2) * 2))


def test_many_values_share_bins(spark, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_VALUES", 6)
    rows = some_rows(300, (0, 1, 2))
    model = fitted(spark, rows, 20, 3)
    chances = model.chances(np.array([x for x, _ in rows]).T)
    right = sum(model.classes[i] == c for i, (_, c) in zip(chances.argmax(axis=0), rows))
    assert right > 140  # a guess among three classes would find 100
    cuts = {float(v) for trees in model.rounds for t in trees for f, v in zip(t.feature, t.threshold) if f == 0}
    assert 2 < len(cuts) <= 6


def test_one_class_and_no_rows(spark):
    model = fitted(spark, [((1, 2, 0), 2)] * 3, 5, 3)
    assert model.rounds == () and model.chances(np.zeros((3, 2))).tolist() == [[1.0, 1.0]]
    with pytest.raises(ValueError):
        fitted(spark, [], 5, 3)


def test_rows_that_no_feature_parts(spark):
    rows = [((1, 1, 1), 0)] * 3 + [((1, 1, 1), 1)] + [((1, 1, 1), 2)] * 2
    model = fitted(spark, rows, 5, 4)
    assert {len(t.feature) for trees in model.rounds for t in trees} == {1}
    assert model.chances(np.ones((3, 1)))[:, 0] == pytest.approx([0.5, 1 / 6, 1 / 3], abs=0.01)


def test_missing_features_go_right(spark):
    model = fitted(spark, some_rows(90, (0, 1, 2)), 3, 2)
    rows = spark.createDataFrame([(None, 1, 1), (99, 1, 1)], "p long, q long, r long")
    one, two = (r["chances"] for r in boosting.score(rows, model, FEATURES).collect())
    assert one == two
