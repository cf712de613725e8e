"""The best slot of each planned title: the boosted model scored over all values of open features.

A leaf is reached if the conditions on the open features and those on the others both hold. So the score of
a title in a slot is a sum over leaves of a product: whether the title may reach the leaf, and the leaf's value
where the slot may reach it. For a batch of titles that is one matrix product per output. No table of
titles by slots is made, and no row is shuffled.
"""

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.plans import boosting
from tallyreel.plans.boosting import Booster, Tree
from tallyreel.plans.forecast import Forecaster, outcome
from tallyreel.schemas import FEATURES
from tallyreel.sources.store import share_package

# Hours come first among equal slots of a day, days before hours.
WEEK = {"day_of_week": range(7), "hour": range(24)}
# Numbers in the largest matrix that a task makes at once.
MOST_CELLS = 1 << 22
DECIMALS = 9


def leaves_reached(tree: Tree, x: np.ndarray, used: Sequence[bool]) -> np.ndarray:
    """Which leaves each row may reach, (leaves, rows), if only the used features decide."""
    reached = np.ones((len(tree.feature), x.shape[1]), dtype=bool)
    for node, feature in enumerate(tree.feature):  # a node stands before its children
        if feature != boosting.LEAF:
            left, right = tree.left[node], tree.right[node]
            reached[left] = reached[right] = reached[node]
            if used[feature]:
                below = x[feature] <= tree.threshold[node]
                reached[left] &= below
                reached[right] &= ~below
    return reached[tree.feature == boosting.LEAF]


class Slots:
    """All combinations of the open features' values, and what each leaf of a model is worth in them."""

    def __init__(self, booster: Booster, features: Sequence[str], open_values: Mapping[str, Sequence[int]]) -> None:
        self.booster = booster
        self.values = np.array(list(itertools.product(*open_values.values())), dtype=np.int64)
        self.closed = [f not in open_values for f in features]
        x = np.zeros((len(features), len(self.values)))
        for i, name in enumerate(open_values):
            x[features.index(name)] = self.values[:, i]
        opened = [not c for c in self.closed]
        self.trees = list(zip(*booster.rounds, strict=True))  # by output
        self.worth = [
            np.concatenate(
                [leaves_reached(t, x, opened) * t.value[t.feature == boosting.LEAF][:, None] for t in trees]
            )
            for trees in self.trees
        ]

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each class, (classes, rows, slots); values of open features in x don't matter."""
        score = np.empty((len(self.booster.start), x.shape[1], len(self.values)))
        score[:] = np.array(self.booster.start)[:, None, None]
        for own, trees, worth in zip(score, self.trees, self.worth, strict=False):
            reached = np.concatenate([leaves_reached(t, x, self.closed) for t in trees])
            own += boosting.STEP * (reached.T.astype(np.float64) @ worth)
        flat = boosting.class_chances(score.reshape(len(score), -1), len(self.booster.classes))
        return flat.reshape(-1, x.shape[1], len(self.values))

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the number of its best slot, the expected class there, and the classes' chances."""
        chances = self.chances(x)
        expected = np.tensordot(np.array(self.booster.classes, dtype=np.float64), chances, axes=1).round(DECIMALS)
        slot = expected.argmax(axis=1)
        rows = np.arange(x.shape[1])
        return slot, expected[rows, slot], chances[:, rows, slot]


def best_slots(
    forecaster: Forecaster, rows: DataFrame, open_values: Mapping[str, Sequence[int]] = WEEK
) -> DataFrame:
    """Each row with its best values of the open features and the forecast there.

    ``rows`` have the features that are not open; a missing one counts as larger than any threshold. Best is
    the slot with the highest expected class, at nine decimals; of equal ones the first in the order of ``open_values``.
    Adds ``slot`` (a struct of the open features), ``expected_class``, ``predicted_class``, ``predicted_category``
    and ``probabilities``. All other columns stay. No rows give no rows.
    """
    share_package(rows.sparkSession)
    booster, names = forecaster.booster, list(open_values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(booster, FEATURES, open_values)
        step = max(1, MOST_CELLS // (max(len(w) for w in [*slots.worth, slots.values]) + 4 * len(slots.values)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.column("x").flatten()])
            # Features are small integers, so a batch has far fewer distinct rows.
            distinct, place = np.unique(x, axis=1, return_inverse=True)
            found = [slots.best(distinct[:, i : i + step]) for i in range(0, distinct.shape[1], step)]
            slot, expected, chances = (np.concatenate(part, axis=-1) for part in zip(*found, strict=True))
            place = place.reshape(-1)
            chosen = slots.values[slot[place]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"),
                    pa.StructArray.from_arrays([pa.array(chosen[:, i]) for i in range(len(names))], names),
                    pa.array(expected[place]),
                    pa.array(chances[:, place].T.tolist(), pa.list_(pa.float64())),
                ],
                ["rest", "slot", "expected_class", "chances"],
            )

    closed = [F.lit(0).cast("long") if f in open_values else F.col(f).cast("long") for f in FEATURES]
    given = rows.select(
        F.struct(*[c.alias(f) for f, c in zip(FEATURES, closed, strict=True)]).alias("x"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("rest"),
    )
    slot = T.StructType([T.StructField(n, T.LongType()) for n in names])
    schema = T.StructType(
        [
            given.schema["rest"],
            T.StructField("slot", slot),
            T.StructField("expected_class", T.DoubleType()),
            T.StructField("chances", T.ArrayType(T.DoubleType())),
        ]
    )
    return given.mapInArrow(run, schema).select(
        *[F.col(f"rest.`{c}`").alias(c) for c in rows.columns], "slot", "expected_class", *outcome(forecaster)
    )
