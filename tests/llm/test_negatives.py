import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfprice.llm import op13_negatives as negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, n_positive, n_negative):
    fit = [
        (i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, y, a in {r for r in fit if is_anchor(r[0])}:
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), j, z) for j, z, b in fit if len(a) == len(b)]
        for s, j, _ in sorted(r for r in scored if r[2] == y and r[1] != i)[:n_positive]:
            fits = sorted((t, o) for t, o, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, j, rank, o, -s, -t) for rank, (t, o) in enumerate(fits[:n_negative], 1)]
    return sorted(out)


def made(n, dims, labels, spread, seed=1):
    pick = random.Random(seed)
    centre = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + pick.gauss(0, spread) for c in centre[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize(("n", "spread", "block", "pack"), [(0, 1.0, 64, 1 << 20), (1, 1.0, 64, 1 << 20), (300, 0.5, 32, 1 << 20), (300, 3.0, 4096, 8 * 6 * 7)])
def test_equals_brute_force(spark, monkeypatch, n, spread, block, pack):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PASS_BYTES", pack)
    rows = made(n, 6, 3, spread)
    # Ties, repeated rows, an id of two labels, another length, and rows that take no part.
    rows += [(1000 + i, v, y) for i, v, y in rows[:20]] + rows[:30] + [(10, v, (y + 1) % 3) for i, v, y in rows[11:12]]
    rows += [(2000, None, 1), (2010, [], 1), (2020, [1.0, None] + [0.0] * 4, 1), (2030, [math.nan] + [0.0] * 5, 1), (2040, [math.inf] + [0.0] * 5, 1), (2050, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 1.0], 1), (3002, [0.5, 0.5], 2), (4000, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"anchor": F.lit("x"), "v": F.lit(1), "rank": F.lit(2), "dims": F.lit(3), "_label": F.lit(4)})
    found = negatives.mined(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, lambda i: i % 10 == 0, 3, 4)


def tree_of(rows, of=10):
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    ids, labels = np.array([i for i, _, _ in rows]), np.array([y for _, _, y in rows])
    at = ids % of == 0
    return negatives.spanning_tree(np.arange(at.sum()), ids[at], labels[at], x[at]), ids, labels, x


def test_tree_spans_and_bounds_hold():
    tree, ids, labels, x = tree_of(made(400, 8, 4, 0.3))
    assert tree.parent[0] == -1 and all(0 <= p < k for k, p in enumerate(tree.parent.tolist()) if k)
    pick = np.random.default_rng(2)
    for k, low, high, score in negatives.bounded(tree, x):
        exact = x @ tree.vectors[k]
        assert (low <= exact).all() and (exact <= high).all()
        at, scores = score(pick.random(len(x)) < 0.2)
        assert (scores == exact[at]).all()


def test_bounds_spare_most_scores():
    # Near anchors: most rows are settled by their parent's scores.
    tree, ids, labels, x = tree_of(made(3000, 16, 4, 0.05), of=30)
    found = [negatives.Found.none(5) for _ in tree.ids]
    asked = negatives.positives_of(tree, ids, labels, x, found)
    windows = [[negatives.window(int(s)) for s in f.scores] for f in found]
    best = [[negatives.Found.none(10) for _ in w] for w in windows]
    asked_negatives = negatives.negatives_of(tree, windows, ids, labels, x, best)
    every = len(x) * (len(tree.ids) - 1)
    assert 0 < asked < 0.3 * every and asked_negatives < 0.3 * every


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 3, 10, 99, 1001])
def test_windows(score):
    least, most = negatives.window(score)
    assert [s for s in range(-50, 1200) if 30 * score <= 100 * s <= 90 * score] == list(range(least, most + 1))


def test_large_components_are_exact():
    rows = np.array([[3 << 40, 1], [1, 5]])
    x, vectors = negatives.comparable(rows, rows)
    assert x.dtype == np.int64 and (x @ vectors.T)[0, 1] == (3 << 40) + 5
