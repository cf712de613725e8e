"""Gradient boosting with the multinomial loss: one tree per class a round.

A round's trees grow together, a level at a time. For every open node of every class, the rows'
gradients are summed per feature and value (a histogram); from the sums come the best splits and
the values of leaves. A few distinct rows are boosted in one task. Beyond ROWS_PER_TASK, every
level is one pass: tasks sum what they hold, the sums of a node meet in one task, which chooses
its split, and the driver sees a row per node, however many bins there are.

Gradients are summed as integers of 48 binary places, so the sums don't depend on the order or
the partitioning of rows, and the same rows give the same model in either way.

Of equal splits the earlier feature, then the smaller threshold is taken. A threshold lies
halfway between two neighbouring values of its node. A node with several values of any feature is
split, down to the greatest depth. With two classes one tree a round separates them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.sources.store import settle, share_package

TREES = 100
DEPTH = 4
STEP = 0.1
# Distinct rows that one task boosts alone, and rows of a pack where many tasks boost together.
ROWS_PER_TASK = 50_000
# Distinct values of a feature that get a bin each; beyond, bins end at as many quantiles.
MOST_VALUES = 4_096
# Rounds after which scores are written out; those since then are added again at each pass.
SETTLED_ROUNDS = 10
# Binary places of each of the two integers that make up a gradient; their sums are exact
# while a pack of rows stands for fewer than 2**29 videos.
PLACES = 24
LEAF = -1
# Weight, then upper and lower integer of gradient and curvature.
SUMS = 5
# Rows in numpy, a pack of them a row; a task's sums of one node; a node's best split.
_PACKS = "bins binary, target binary, weight binary, score binary"
_PARTS = "node long, used binary, sums binary"
_SPLITS = "node long, gain double, feature long, threshold double, total array<long>, left array<long>"
_SPLIT_COLUMNS = [c.split()[0] for c in _SPLITS.split(", ")]


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth-first order; ``feature`` is LEAF in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def node_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each row ends in; x is (features, rows).

        Trees are shallow, so a pass over the rows for every node is cheaper than following each row.
        """
        node = np.zeros(x.shape[1], dtype=np.min_scalar_type(len(self.feature)))
        for at in np.flatnonzero(self.feature != LEAF):  # parents come before their children
            goes_left = x[self.feature[at]] <= self.threshold[at]
            sides = np.where(goes_left, node.dtype.type(self.left[at]), node.dtype.type(self.right[at]))
            node = np.where(node == at, sides, node)
        return node


@dataclass(frozen=True)
class Facts:
    """What is known of the training rows before the first round."""

    classes: tuple[int, ...]
    start: tuple[float, ...]  # first score of each output
    uppers: tuple[np.ndarray, ...]  # ascending, the largest value of each feature's bins
    exact: tuple[bool, ...]  # whether a feature has a bin for every value

    @property
    def outputs(self) -> int:
        return len(self.start)

    @property
    def offsets(self) -> np.ndarray:
        """First bin of each feature, and the number of bins."""
        return np.concatenate([[0], np.cumsum([len(u) for u in self.uppers])])

    @property
    def bin_type(self) -> np.dtype:
        return np.min_scalar_type(int(self.offsets[-1]))

    def binned(self, tree: Tree) -> Tree:
        """The tree over bins: a value is not above a threshold if its bin's end is not."""
        offsets, cut = self.offsets, np.zeros(len(tree.feature), dtype=np.int64)
        for node in np.flatnonzero(tree.feature != LEAF):
            own = tree.feature[node]
            cut[node] = offsets[own] + np.searchsorted(self.uppers[own], tree.threshold[node], "right") - 1
        return replace(tree, threshold=cut)


@dataclass(frozen=True)
class Booster:
    """Fitted rounds of trees, one per output."""

    classes: tuple[int, ...]
    start: tuple[float, ...]
    rounds: tuple[tuple[Tree, ...], ...]

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each of the classes: (classes, rows); x is (features, rows)."""
        score = np.repeat(np.array(self.start)[:, None], x.shape[1], axis=1)
        for trees in self.rounds:
            _add(score, trees, x)
        return class_chances(score, len(self.classes))

    def importance(self, features: int) -> list[float]:
        """Share of each feature in what all splits gain."""
        total = np.zeros(features)
        for tree in (t for trees in self.rounds for t in trees):
            inner = tree.feature != LEAF
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return (total / (total.sum() or 1.0)).tolist()


def _add(score: np.ndarray, trees: Sequence[Tree], x: np.ndarray) -> None:
    for own, tree in zip(score, trees, strict=True):
        own += STEP * tree.value[tree.node_of(x)]


def class_chances(score: np.ndarray, classes: int) -> np.ndarray:
    """Probabilities (classes, rows) from the outputs' scores (outputs, rows)."""
    if classes == 1:
        return np.ones((1, score.shape[1]))
    if classes == 2:
        second = 1 / (1 + np.exp(-score[0]))
        return np.stack([1 - second, second])
    powers = np.exp(score - score.max(axis=0))
    return powers / powers.sum(axis=0)


def _limbs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers per value, of PLACES binary places each."""
    upper = np.rint(values * (1 << PLACES))
    return upper, np.rint((values * (1 << PLACES) - upper) * (1 << PLACES))


def _whole(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return (upper + lower / (1 << PLACES)) / (1 << PLACES)


class _Growing:
    """One output's tree while it grows, with the nodes that may still be split."""

    def __init__(self) -> None:
        self.nodes = [[LEAF, 0.0, 0, 0, 0.0, 0.0]]
        self.open = [0]

    def tree(self) -> Tree:
        feature, threshold, left, right, value, gain = zip(*self.nodes, strict=True)
        whole = (np.array(c, dtype=np.int64) for c in (feature, left, right))
        feature, left, right = whole
        return Tree(feature, np.array(threshold), left, right, np.array(value), np.array(gain))


class Rows:
    """Training rows in numpy: bins (features, rows), class numbers, weights and scores."""

    def __init__(self, facts: Facts, bins: np.ndarray, target: np.ndarray, weight: np.ndarray, score: np.ndarray):
        self.facts, self.bins, self.target, self.weight, self.score = facts, bins, target, weight, score

    @staticmethod
    def read(facts: Facts, table: pa.RecordBatch | pa.Table, features: Sequence[str]) -> Rows:
        """Rows that no tree has scored yet."""
        found = [np.searchsorted(u, table.column(f).to_numpy()) for u, f in zip(facts.uppers, features, strict=True)]
        bins = (np.stack(found) + facts.offsets[:-1, None]).astype(facts.bin_type)
        target = np.searchsorted(np.array(facts.classes), table.column("category").to_numpy())
        score = np.repeat(np.array(facts.start)[:, None], len(target), axis=1)
        return Rows(facts, bins, target, table.column("videos").to_numpy(), score)

    @staticmethod
    def unpack(facts: Facts, pack: dict[str, bytes]) -> Rows:
        target, weight = (np.frombuffer(pack[c], dtype=np.int64) for c in ("target", "weight"))
        bins = np.frombuffer(pack["bins"], dtype=facts.bin_type).reshape(len(facts.uppers), -1)
        score = np.frombuffer(pack["score"]).reshape(facts.outputs, -1).copy()
        return Rows(facts, bins, target, weight, score)

    def packed(self) -> pa.RecordBatch:
        """One row of _PACKS."""
        columns = {
            "bins": self.bins, "target": self.target.astype(np.int64), "weight": self.weight.astype(np.int64),
            "score": self.score,
        }
        return pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()})

    def add(self, trees: Sequence[Tree]) -> None:
        _add(self.score, [self.facts.binned(t) for t in trees], self.bins)

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        chance = class_chances(self.score, len(self.facts.classes))
        numbers = np.arange(len(self.facts.classes))
        gradient = (self.target == numbers[:, None]) - chance
        if self.facts.outputs == 1:
            gradient = gradient[1:]
        return gradient, np.abs(gradient) * (1 - np.abs(gradient))

    def sums(self, growing: Sequence[_Growing]) -> np.ndarray:
        """Whole-number sums by open node and bin: (nodes, bins, SUMS)."""
        offsets = self.facts.offsets
        parts = []
        for own, gradient, curvature in zip(growing, *self.gradients(), strict=True):
            slot = np.full(len(own.nodes), LEAF)
            slot[own.open] = np.arange(len(own.open))
            slot = slot[self.facts.binned(own.tree()).node_of(self.bins)]
            here = np.flatnonzero(slot != LEAF)
            slot, weight = slot[here], self.weight[here].astype(np.float64)
            values = [weight, *(weight * v for u in (gradient, curvature) for v in _limbs(u[here]))]
            out = np.empty((len(own.open), int(offsets[-1]), SUMS), dtype=np.int64)
            for feature, (first, end) in enumerate(zip(offsets, offsets[1:])):
                keys = slot * (end - first) + (self.bins[feature, here] - first)
                for i, v in enumerate(values):
                    counted = np.bincount(keys, v, len(own.open) * (end - first))
                    out[:, first:end, i] = counted.reshape(len(own.open), -1)
            parts.append(out)
        return np.concatenate(parts)


def _leaf(gradient: float, curvature: float, classes: int) -> float:
    share = 1.0 if classes == 2 else (classes - 1) / classes
    return 0.0 if abs(curvature) < 1e-150 else share * gradient / curvature


@dataclass(frozen=True)
class _Split:
    """A node's best split, its whole-number sums and those of its left side; no split has a gain below 0."""

    gain: float
    feature: int
    threshold: float
    total: np.ndarray
    left: np.ndarray


def _best(facts: Facts, sums: np.ndarray) -> list[_Split]:
    """The best split of each node from its sums (nodes, bins, SUMS)."""
    offsets = facts.offsets
    first = np.repeat(offsets[:-1], np.diff(offsets))
    weight = sums[..., 0].astype(np.float64)

    def below(values: np.ndarray) -> np.ndarray:
        """Whole-number sums up to each bin of a feature."""
        running = np.concatenate([np.zeros((len(values), 1), dtype=np.int64), np.cumsum(values, axis=1)], axis=1)
        return running[:, 1:] - running[:, first]

    left = np.stack([below(sums[..., i]) for i in range(SUMS)], axis=-1)
    total = left[:, offsets[1] - 1, :]
    right = total[:, None, :] - left
    lw, rw = left[..., 0].astype(np.float64), right[..., 0].astype(np.float64)
    lg, rg = _whole(left[..., 1], left[..., 2]), _whole(right[..., 1], right[..., 2])
    possible = (weight > 0) & (rw > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(possible, lw * rw / (lw + rw) * (lg / lw - rg / rw) ** 2, -1.0)
    found = []
    for node, cut in enumerate(gain.argmax(axis=1)):
        feature = int(np.searchsorted(offsets, cut, "right")) - 1
        uppers = facts.uppers[feature]
        here = int(cut - offsets[feature])
        threshold = float(uppers[here])
        if facts.exact[feature] and gain[node, cut] >= 0:
            later = np.flatnonzero(weight[node, cut + 1 : offsets[feature + 1]])
            threshold = (threshold + float(uppers[here + 1 + later[0]])) / 2
        found.append(_Split(float(gain[node, cut]), feature, threshold, total[node], left[node, cut]))
    return found


def _split(facts: Facts, growing: Sequence[_Growing], found: Sequence[_Split], last: bool) -> None:
    """Split the open nodes where that gains; new nodes are open, unless they are the last."""

    def value(sums: np.ndarray) -> float:
        return float(_leaf(_whole(sums[1], sums[2]), _whole(sums[3], sums[4]), len(facts.classes)))

    splits = iter(found)
    for own in growing:
        opened, own.open = own.open, []
        for at in opened:
            split, row = next(splits), own.nodes[at]
            row[4] = value(split.total)
            if split.gain >= 0:
                row[:4] = [split.feature, split.threshold, len(own.nodes), len(own.nodes) + 1]
                row[4:] = [0.0, split.gain]
                for side in (split.left, split.total - split.left):
                    if not last:
                        own.open.append(len(own.nodes))
                    own.nodes.append([LEAF, 0.0, 0, 0, value(side), 0.0])


def _grown(facts: Facts, depth: int, best: Callable[[list[_Growing]], Sequence[_Split]]) -> tuple[Tree, ...]:
    """One round of trees from the splits that their levels ask for."""
    growing = [_Growing() for _ in range(facts.outputs)]
    for level in range(depth):
        if not any(g.open for g in growing):
            break
        _split(facts, growing, best(growing), level == depth - 1)
    return tuple(g.tree() for g in growing)


TREE_COLUMNS = {
    **dict.fromkeys(("round", "output", "node", "feature"), "long"),
    "threshold": "double",
    **dict.fromkeys(("left", "right"), "long"),
    **dict.fromkeys(("value", "gain"), "double"),
}
_TREES = ", ".join(f"{name} {kind}" for name, kind in TREE_COLUMNS.items())
TREE_FIELDS = ", ".join(f"{name}: {kind}" for name, kind in TREE_COLUMNS.items())


def _table(rounds: Sequence[Sequence[Tree]]) -> pa.Table:
    """Trees as rows of _TREES."""
    columns: list[list] = [[] for _ in TREE_COLUMNS]
    for number, trees in enumerate(rounds):
        for output, t in enumerate(trees):
            n = len(t.feature)
            own = [[number] * n, [output] * n, range(n), t.feature, t.threshold, t.left, t.right, t.value, t.gain]
            for column, values in zip(columns, own, strict=True):
                column.extend(values.tolist() if isinstance(values, np.ndarray) else values)
    types = [pa.float64() if kind == "double" else pa.int64() for kind in TREE_COLUMNS.values()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(TREE_COLUMNS))


def tree_rows(booster: Booster) -> list[tuple]:
    """Trees as plain rows of _TREES."""
    return list(zip(*_table(booster.rounds).to_pydict().values(), strict=True))


def trees_of(rows: Sequence[Sequence]) -> tuple[tuple[Tree, ...], ...]:
    """Rounds of trees from rows of _TREES, in any order."""
    found: dict[tuple[int, int], list[Sequence]] = {}
    for row in sorted(rows, key=lambda r: tuple(r)[:3]):
        found.setdefault((row[0], row[1]), []).append(row)
    rounds: list[list[Tree]] = []
    for (number, _), own in found.items():
        if number == len(rounds):
            rounds.append([])
        columns = [np.array(c) for c in list(zip(*own, strict=True))[3:]]
        rounds[number].append(Tree(*columns))
    return tuple(tuple(trees) for trees in rounds)


def _alone(facts: Facts, features: Sequence[str], trees: int, depth: int):
    """All rounds in one task."""

    def run(table: pa.Table) -> pa.Table:
        rows, rounds = Rows.read(facts, table, features), []
        for _ in range(trees):
            rounds.append(_grown(facts, depth, lambda growing: _best(facts, rows.sums(growing))))
            rows.add(rounds[-1])
        return _table(rounds)

    return run


def _pack(facts: Facts, features: Sequence[str]):
    """Rows of points as packs, so that a pass reads whole arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_PER_TASK:
                yield Rows.read(facts, pa.Table.from_batches(held), features).packed()
                held = []
        if any(b.num_rows for b in held):
            yield Rows.read(facts, pa.Table.from_batches(held), features).packed()

    return run


def _unpacked(facts: Facts, pending: list[tuple[Tree, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Packs with the scores that the pending rounds give them."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = Rows.unpack(facts, batch.slice(i, 1).to_pylist()[0])
            for trees in pending:
                rows.add(trees)
            yield rows


def _partial(facts: Facts, pending: list[tuple[Tree, ...]], growing: list[_Growing]):
    """A task's sums, a row for each node; bins without rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((sum(len(g.open) for g in growing), int(facts.offsets[-1]), SUMS), dtype=np.int64)
        for rows in _unpacked(facts, pending, batches):
            total += rows.sums(growing)
        for node, sums in enumerate(total):
            used = np.flatnonzero(sums[:, 0])
            columns = [pa.array([node]), *(pa.array([v.tobytes()], pa.binary()) for v in (used, sums[used]))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "used", "sums"])

    return run


def _merged(facts: Facts):
    """The best splits of the nodes whose sums come to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, used, sums in zip(*(batch.column(c).to_pylist() for c in ("node", "used", "sums"))):
                total = nodes.setdefault(node, np.zeros((int(facts.offsets[-1]), SUMS), dtype=np.int64))
                total[np.frombuffer(used, dtype=np.int64)] += np.frombuffer(sums, dtype=np.int64).reshape(-1, SUMS)
        rows = [vars(_best(facts, total[None])[0]) | {"node": node} for node, total in nodes.items()]
        if rows:
            columns = {c: [r[c].tolist() if c in ("total", "left") else r[c] for r in rows] for c in _SPLIT_COLUMNS}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _advance(facts: Facts, pending: list[tuple[Tree, ...]]):
    """Packs with the scores that the pending rounds give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unpacked(facts, pending, batches):
            yield rows.packed()

    return run


def _spread(dealt: DataFrame, facts: Facts, features: Sequence[str], trees: int, depth: int):
    """All rounds, each level one pass over the points."""
    tasks = dealt.rdd.getNumPartitions()
    packs = settle(dealt.mapInArrow(_pack(facts, features), _PACKS), "packed")
    rounds: list[tuple[Tree, ...]] = []
    pending: list[tuple[Tree, ...]] = []

    def best(growing: list[_Growing]) -> list[_Split]:
        """A row for each open node, however many rows and bins are summed."""
        nodes = sum(len(g.open) for g in growing)
        parts = packs.mapInArrow(_partial(facts, list(pending), growing), _PARTS)
        met = parts.repartition(min(nodes, tasks), "node").mapInArrow(_merged(facts), _SPLITS)
        found = {r.pop("node"): r for r in met.toArrow().to_pylist()}
        whole = [{c: np.array(v) if c in ("total", "left") else v for c, v in found[n].items()} for n in range(nodes)]
        return [_Split(**row) for row in whole]

    for _ in range(trees):
        rounds.append(_grown(facts, depth, best))
        pending.append(rounds[-1])
        if len(pending) == SETTLED_ROUNDS and len(rounds) < trees:
            before, packs = packs, settle(packs.mapInArrow(_advance(facts, pending), _PACKS), "boosted")
            packs.count()  # computed from the packs before, which then can go
            before.unpersist()
            pending = []
    return rounds


def _bins(points: DataFrame, features: Sequence[str]) -> tuple[tuple[np.ndarray, ...], tuple[bool, ...]]:
    """Upper ends of each feature's bins, and whether every value has its own."""
    long = points.select(*features).unpivot([], list(features), "feature", "value")
    values = settle(long.distinct(), "feature-values")
    counts = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    few = [f for f in features if counts[f] <= MOST_VALUES]
    found: dict[str, list[int]] = {f: [] for f in features}
    for r in values.filter(F.col("feature").isin(few)).collect():  # at most MOST_VALUES each
        found[r["feature"]].append(r["value"])
    shares = [i / MOST_VALUES for i in range(1, MOST_VALUES + 1)]
    for f in (f for f in features if counts[f] > MOST_VALUES):
        ends = F.percentile_approx("value", shares, 10 * MOST_VALUES).alias("ends")
        row = values.filter(F.col("feature") == f).agg(ends, F.max("value").alias("top")).first()
        found[f] = [*row["ends"], row["top"]]
    uppers = tuple(np.unique(np.array(found[f], dtype=np.int64)) for f in features)
    return uppers, tuple(f in few for f in features)


def points_of(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Equal training rows as one row with their number, ``videos``; written out, as each pass reads them."""
    whole = rows.select(*[F.col(f).cast("long").alias(f) for f in features], F.col("category").cast("long"))
    return settle(whole.groupBy(*features, "category").agg(F.count("*").alias("videos")), "training")


def fit(points: DataFrame, features: Sequence[str], trees: int = TREES, depth: int = DEPTH) -> Booster:
    """Boosted trees from ``points_of`` rows.

    Classes are those that occur; with one alone there is nothing to learn. No rows are an error.
    """
    share_package(points.sparkSession)
    seen = points.groupBy("category").agg(F.sum("videos").alias("videos"), F.count("*").alias("rows")).collect()
    if not seen:
        raise ValueError("no training rows")
    seen = sorted(seen, key=lambda r: r["category"])
    weights = np.array([r["videos"] for r in seen], dtype=np.float64)
    classes = tuple(r["category"] for r in seen)
    if len(classes) == 1:
        return Booster(classes, (0.0,), ())
    share = weights / weights.sum()
    start = (float(np.log(share[1] / share[0])),) if len(classes) == 2 else tuple(np.log(share).tolist())
    facts = Facts(classes, start, *_bins(points, features))
    size = sum(r["rows"] for r in seen)
    if size <= ROWS_PER_TASK:
        together = points.withColumn("model", F.lit(0)).groupBy("model")
        rounds = trees_of(together.applyInArrow(_alone(facts, features, trees, depth), _TREES).collect())
    else:
        dealt = points.repartition(1 + size // ROWS_PER_TASK, *features)
        rounds = tuple(_spread(dealt, facts, features, trees, depth))
    return Booster(classes, start, rounds)


def score(rows: DataFrame, booster: Booster, features: Sequence[str]) -> DataFrame:
    """``rest`` (the struct of all columns) and ``chances``, one for each of the booster's classes.

    A missing feature counts as larger than any threshold.
    """
    share_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.column("x").flatten()])
                chances = pa.array(booster.chances(x).T.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("rest"), chances], ["rest", "chances"])

    wanted = F.struct(*[F.col(f).cast("long").alias(f) for f in features]).alias("x")
    given = rows.select(wanted, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("rest"))
    schema = T.StructType([given.schema["rest"], T.StructField("chances", T.ArrayType(T.DoubleType()))])
    return given.mapInArrow(run, schema)
