import math
import random

import pytest
from pyspark.sql import functions as F

from shelfprice.llm import op07_search as search


def brute(rows, k, is_query):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in fit:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fit if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize(("n", "block", "spread"), [(0, 50, 1.0), (1, 50, 1.0), (30, 7, 1.0), (400, 64, 0.6), (300, 64, 0.02)])
def test_equals_brute_force(spark, monkeypatch, n, block, spread):
    monkeypatch.setattr(search, "BLOCK", block)
    pick = random.Random(n)
    rows = [(i, [pick.gauss(0, spread) for _ in range(8)]) for i in range(n)]
    # Ties, odd lengths and vectors that take no part.
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:20])]
    rows += [(2000, None), (2020, []), (2040, [1.0, None] + [0.0] * 6), (2060, [math.nan] + [0.0] * 7), (2080, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (2100, [1.0, 2.0]), (2101, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    found = search.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {tuple(r) for r in found} == brute(rows, 5, lambda i: i % 20 == 0)
    assert len(found) == len({tuple(r) for r in found})


def test_bounds_hold_and_spare_reads():
    import numpy as np

    pick = np.random.default_rng(1)
    x, q = pick.integers(-40, 40, (2000, 16)), pick.integers(-40, 40, (3, 16))
    for qid, ids, scores in search.top_of_block((np.arange(3), q), (np.arange(2000), x), 10):
        exact = x @ q[qid]
        keep = np.arange(2000) != qid
        order = np.lexsort((np.arange(2000)[keep], -exact[keep]))[:10]
        assert ids.tolist() == np.arange(2000)[keep][order].tolist()
        assert scores.tolist() == exact[keep][order].tolist()


def test_repeated_rows_count_in_any_layout(spark):
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(1, 9)]
    query = [(0, [1.0, 0.5, -0.5, 0.25])]
    schema = "vec_id long, embedding array<double>"
    apart = spark.createDataFrame(rows, schema).coalesce(1).union(spark.createDataFrame(rows, schema).coalesce(1)).union(spark.createDataFrame(query, schema).coalesce(1))
    answers = [sorted(tuple(r) for r in search.top_k(df, F.col("vec_id") == 0, k=6).collect()) for df in (apart, apart.coalesce(1))]
    scores = sorted((-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(query[0][1], v, strict=True)), i) for i, v in rows + rows)
    assert answers == [[(0, rank, i, -s) for rank, (s, i) in enumerate(scores[:6], 1)]] * 2
