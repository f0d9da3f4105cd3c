"""Hard negatives by STR-packed trees against brute force."""

import math
import random

import numpy as np
import pytest

from quarry.llm import str_tree


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    read = []
    for i, label, vector in rows:
        if i is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        read.append((i, label, [math.floor(x * scale) for x in vector]))
    anchors = {}
    for i, label, q in read:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    found = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i, other == label) for i, other, p in read if i != a)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            hard = [(-t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            found += [(a, i, rank + 1, n, -s, t) for rank, (t, n) in enumerate(hard)]
    return sorted(found)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, point string, anchor_id int")
    return sorted(map(tuple, str_tree.mine(frame, **options).collect()))


def unit(draw, size):
    v = np.array([draw.gauss(0, 1) for _ in range(size)])
    return [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]


def test_against_brute_force(spark):
    draw = random.Random(5)
    centres = [unit(draw, 8) for _ in range(6)]
    rows = []
    for i in range(700):
        c = draw.randrange(6)
        rows.append((i, c % 4, [float(np.float32(x + draw.gauss(0, 0.25))) for x in centres[c]]))
    # A third of the rows is one vector; ties go to the smaller id.
    rows += [(700 + i, draw.randrange(4), rows[0][2]) for i in range(350)]
    rows += [(2000, None, rows[1][2]), (2100, 1, None), (2200, 1, [1.0, None] * 4), (2300, 2, [float("nan")] * 8), (2400, 2, [float("inf")] * 8), (None, 1, rows[2][2]), (2500, 1, []), (2600, 1, [0.0] * 8)]
    rows += [(100, 3, rows[100][2]), (100, 0, rows[7][2]), (33, 1, rows[33][2]), (33, 1, rows[33][2])]
    found = got(spark, rows, block=64, leaf=8, slab=100, anchors=4)
    assert found == brute(rows) and len(found) > 100
    # Whatever the shape of the trees.
    assert got(spark, rows, block=1000, leaf=16, slab=5000) == found


def test_windows_of_neighbouring_scores_are_kept_apart(spark):
    # Scores 10 and 11 have windows 3..9 and 4..9.
    rows = [(0, 1, [1.0]), (1, 1, [10.0]), (2, 1, [11.0])] + [(10 + i, 2, [float(i)]) for i in range(12)]
    assert got(spark, rows, scale=1, negatives=20) == brute(rows, scale=1, negatives=20)


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [1.0])], [(1, 1, [1.0])]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_large_components_take_no_part(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0])]
    assert got(spark, rows + [(3, 2, [3e38, 0.0])]) == brute(rows)


def test_pruning_opens_few_leaves():
    """Boxes outside the windows or below the k-th score stay closed."""
    draw = np.random.default_rng(3)
    points = np.floor(256 * np.repeat(draw.normal(size=(64, 4)), 32, 0) + draw.normal(size=(2048, 4)) * 4)
    points = points[str_tree.str_order(points, 32)]
    opened = []

    class Counting(str_tree.Best):
        def offer(self, scores, ids):
            opened.append(len(scores))
            super().offer(scores, ids)

    best = Counting(np.array([-np.inf]), np.array([np.inf]), 5)
    str_tree.search_block(str_tree.PackedTree(points, 32), np.arange(2048), np.array([-1]), points[:1], [best])
    scores = points @ points[0]
    assert best.scores[0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert sum(opened) < 2048 / 4
