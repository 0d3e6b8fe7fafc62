"""Top-k search: work of a group, thresholds, kinds of numbers and the plan."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tontine.llm import topk


class Counted(np.ndarray):
    """Rows that count the products of matrices they enter and the scores that come out."""

    products = scores = 0

    def __matmul__(self, other):
        out = np.asarray(self) @ np.asarray(other)
        Counted.products, Counted.scores = Counted.products + 1, Counted.scores + out.size
        return out


def brute(ids, rows, query_ids, queries, k):
    out = set()
    for q, v in zip(query_ids, queries):
        scores = [(-sum(int(a) * int(b) for a, b in zip(v, w)), int(i)) for i, w in zip(ids, rows) if i != q]
        out |= {(int(q), i, -s) for s, i in sorted(scores)[:k]}
    return out


def searched(*args):
    return {(int(q), int(i), int(s)) for q, i, s in zip(*topk.search_group(*args))}


def test_a_block_meets_its_queries_in_one_product():
    rng = np.random.default_rng(1)
    rows, ids = np.floor(rng.normal(0, 40, (128, 8))), np.arange(128)
    Counted.products = Counted.scores = 0
    got = searched(ids, rows.view(Counted), ids, rows, 5, 16)
    assert got == brute(ids, rows, ids, rows, 5)
    assert Counted.products <= 8 * 4  # 8 blocks, 4 rounds; not one for each of 128 queries and their blocks


def test_bounds_end_the_visits():
    rng = np.random.default_rng(2)
    centres = np.repeat(np.eye(16) * 1000, 16, axis=0)  # a block of rows about each of 16 directions
    rows, ids = np.floor(centres + rng.normal(0, 3, centres.shape)), np.arange(256)
    Counted.products = Counted.scores = 0
    got = searched(ids, rows.view(Counted), ids, rows, 5, 16)
    assert got == brute(ids, rows, ids, rows, 5)
    assert Counted.scores == 256 * 16  # the own block of each query, no other


@pytest.mark.parametrize("waiting", [0, 1 << 20])
@pytest.mark.parametrize(("size", "kind"), [(3, np.float32), (2000, np.float64), (3e6, np.float64), (2e8, np.int64), (4.5e8, object)])
def test_ties_and_kinds_of_numbers(monkeypatch, size, kind, waiting):
    monkeypatch.setattr(topk, "WAITING", waiting)
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, size, (60, 4)))[rng.integers(0, 60, 150)]
    ids = rng.permutation(150)
    ids[:2] = 2**63 - 1, 10**6
    most = float(np.abs(rows).max()) ** 2 * 4
    whole = topk.whole(rows, most)
    assert whole.dtype == kind
    for k in (1, 5, 200):
        assert searched(ids, whole, ids[:40], whole[:40], k, 16) == brute(ids, rows, ids[:40], rows[:40], k)


def test_unsound_vectors_take_no_part(spark):
    nan, inf = math.nan, math.inf
    odd = [[nan, 1.0], [1.0, nan], [inf, 1.0], [1.0, -inf], [None, 1.0], [1.0, None], [None, None], [], None]
    rows = [(i, v) for i, v in enumerate(odd)] + [(100, [1.0, -2.0]), (101, [3.0, 4.0])]
    got = topk.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {(r.id, *r.v, r.dim, r.code) for r in got.collect()} == {(100, 1.0, -2.0, 2, -2), (101, 3.0, 4.0, 2, 2)}


def test_vectors_are_shuffled_once_to_the_grid(spark):
    rows = [(i, [float(i % 7 - 3), 1.0, float(i % 5)]) for i in range(400)]
    df = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 4 == 0, group_rows=50, band_queries=40)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Both sides go straight to the 8 x 3 cells, a task each; the third exchange is that of the last window.
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and plan.count(", 24), REPARTITION_BY_NUM") == 2
    assert plan.count("Exchange hashpartitioning") == 1
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    queries = [i for i in whole if i % 4 == 0]
    want = brute(list(whole), list(whole.values()), queries, [whole[q] for q in queries], 5)
    assert {(r.query_id, r.vec_id, r.score) for r in df.collect()} == want
