import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives as ng

ROWS = "vec_id long, label long, vector array<long>"


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    dim = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, k, list(v) + [0] * (dim - len(v))) for i, k, v in {(i, k, tuple(v)) for i, k, v in rows}]
    out = []
    for i, k, v in rows:
        if not anchor(i):
            continue
        s = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, l_) for j, l_, w in rows if j != i]
        for score, j in sorted((score, j) for score, j, l_ in s if l_ == k)[:positives]:
            p = -score
            band = sorted((n, m) for n, m, l_ in s if l_ != k and low * p <= -100 * n <= high * p)[:negatives]
            out += [(i, j, r + 1, m, p, -n) for r, (n, m) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(map(tuple, ng.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 3 == 0, **how).collect()))


@pytest.fixture
def clustered():
    r = np.random.default_rng(3)
    centres = r.normal(0, 60, (6, 8))
    v = np.floor(centres[r.integers(0, 6, 400)] + r.normal(0, 25, (400, 8))).astype(int)
    rows = [(int(i), int(k), x.tolist()) for i, k, x in zip(r.permutation(400), r.integers(0, 4, 400), v, strict=True)]
    return rows + [(1000 + i, 1, rows[0][2]) for i in range(200)] + [(2000, 9, rows[1][2]), (2001, 3, [0] * 8), (2004, 3, [0] * 8)]


@pytest.mark.parametrize("how", [{}, {"pivots": 7, "group_anchors": 9, "chunk_rows": 50}, {"pivots": 1, "group_anchors": 1000, "chunk_rows": 10_000, "positives": 2, "negatives": 3}])
def test_against_all_scores(spark, clustered, how):
    some = {k: how[k] for k in ("positives", "negatives") if k in how}
    want = plain(clustered, lambda i: i % 3 == 0, **some)
    assert len(want) > 500 and mined(spark, clustered, **how) == want


def test_ties_repeats_and_sizes(spark):
    rows = [(3, 1, [5, 0]), (3, 1, [5, 0]), (6, 1, [5]), (6, 2, [4, 4]), (7, 1, [5, 9]), (8, 2, [3, 0]), (9, 2, [3, 1, 2]), (9, 2, [3, 1, 2]), (10, 2, [-8, 0]), (12, 1, []), (15, 5, [7, 7])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 3 == 0)


def test_large_components(spark):
    big = 1 << 29
    rows = [(0, 1, [big, 3]), (1, 1, [big, 1]), (2, 2, [big // 2, 1]), (4, 2, [big // 2 + 1, -(1 << 27)]), (5, 2, [1, 1])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 3 == 0) != []


def test_rows_that_take_no_part(spark):
    rows = [(0, 1, [4, 4]), (None, 1, [4, 4]), (1, None, [4, 4]), (2, 1, None), (4, 1, [4, None]), (5, 1, [1 << 62, 1]), (7, 1, [3, 3]), (8, 2, [2, 2])]
    assert mined(spark, rows) == [(0, 7, 1, 8, 24, 16)]
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [2])]) == [] and mined(spark, [(3, 1, [2])]) == []


def test_other_columns(spark):
    rows = spark.createDataFrame([(0, 1, [4, 4], 1, 2), (7, 1, [3, 3], 1, 2), (8, 2, [2, 2], 1, 2)], ROWS + ", anchor int, group int")
    assert ng.hard_negatives(rows, F.col("vec_id") % 3 == 0).count() == 1


def test_bounds_prune(spark, clustered):
    """Far cells are not dealt to groups that they can't serve."""
    held = ng.packed(spark.createDataFrame(clustered, ROWS), F.lit(True))
    cells, n = ng._cells(held, 8)
    groups = {c: (c, 1) for c in range(len(cells.pivots))}
    near = ng._dealt(held, cells, groups, 1, lambda labels, d, own: d <= np.partition(d, 0, axis=1)[:, :1])
    assert near.count() < 2 * n < ng._dealt(held, cells, groups, 1, lambda labels, d, own: d < np.inf).count() == n * len(groups)


def test_products_are_exact():
    a, c = np.array([[1 << 30, -(1 << 30)], [1, 2]]), np.array([[(1 << 30) - 1, (1 << 30) - 3], [3, 4]])
    assert ng.products(a, c).tolist() == [[(1 << 31), -(1 << 30)], [(1 << 30) - 1 + 2 * ((1 << 30) - 3), 11]]
    assert ng.products(a // (1 << 20), c % 7).tolist() == (a // (1 << 20) @ (c % 7).T).tolist()
