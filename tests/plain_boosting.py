"""Multinomial boosting in plain Python: exhaustive splits, exactly rounded sums."""

import math
from collections import Counter

STEP = 0.1


def softmax(scores):
    powers = [math.exp(s - max(scores)) for s in scores]
    return [p / math.fsum(powers) for p in powers]


def chances(scores, n_classes):
    if n_classes == 2:
        second = 1 / (1 + math.exp(-scores[0]))
        return [1 - second, second]
    return softmax(scores)


def best_split(rows, residuals):
    """(gain, feature, threshold) of the rows, or None; earlier features and smaller thresholds win."""
    found = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            left = [e for r, e in zip(rows, residuals) if r[f] <= low]
            right = [e for r, e in zip(rows, residuals) if r[f] > low]
            a, b = len(left), len(right)
            gain = a * b / (a + b) * (math.fsum(left) / a - math.fsum(right) / b) ** 2
            if found is None or gain > found[0] + 1e-12:
                found = (gain, f, (low + high) / 2)
    return found


def grow(rows, residuals, depth, n_classes):
    cut = best_split(rows, residuals) if depth else None
    if cut is None:
        below = math.fsum(abs(e) * (1 - abs(e)) for e in residuals)
        share = 1.0 if n_classes == 2 else (n_classes - 1) / n_classes
        return 0.0 if abs(below) < 1e-150 else share * math.fsum(residuals) / below
    gain, f, threshold = cut
    sides = []
    for is_left in (True, False):
        at = [i for i, r in enumerate(rows) if (r[f] <= threshold) == is_left]
        sides.append(grow([rows[i] for i in at], [residuals[i] for i in at], depth - 1, n_classes))
    return (gain, f, threshold, *sides)


def leaf_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree


def gains(tree, out):
    if isinstance(tree, tuple):
        out[tree[1]] += tree[0]
        gains(tree[3], out)
        gains(tree[4], out)


class Plain:
    def __init__(self, rows, labels, trees, depth):
        self.classes = sorted(set(labels))
        n, k = len(rows), len(self.classes)
        share = [Counter(labels)[c] / n for c in self.classes]
        self.start = [math.log(share[1] / share[0])] if k == 2 else [math.log(s) for s in share]
        self.rounds = []
        scores = [list(self.start) for _ in rows]
        for _ in range(trees):
            now = [chances(s, k) for s in scores]
            own = []
            for output in range(len(self.start)):
                c = 1 if k == 2 else output
                residuals = [(labels[i] == self.classes[c]) - now[i][c] for i in range(n)]
                own.append(grow(rows, residuals, depth, k))
            self.rounds.append(own)
            for row, score in zip(rows, scores):
                for output, tree in enumerate(own):
                    score[output] += STEP * leaf_of(tree, row)

    def chances(self, row):
        scores = list(self.start)
        for own in self.rounds:
            scores = [s + STEP * leaf_of(t, row) for s, t in zip(scores, own)]
        return chances(scores, len(self.classes))

    def importance(self, n_features):
        total = [0.0] * n_features
        for own in self.rounds:
            for tree in own:
                gains(tree, total)
        return [t / math.fsum(total) for t in total]
