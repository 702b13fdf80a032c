"""Neighbours across jittered borders by brute force, and the uniqueness check inside a join."""

import numpy as np
import pytest

from cohortlens.operators import groups as G
from cohortlens.operators import spatial as A


def test_neighbours_of_jittered_squares(spark):
    rng = np.random.default_rng(14)
    snap = 0.01
    rows = []
    for i in range(6):
        for j in range(6):
            gap = 0.2 if (i, j) == (5, 5) else 0.0  # an area of its own
            for dx, dy in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0)):
                jitter = rng.uniform(-0.6, 0.6, 2) * snap
                rows.append((10 * i + j, float(i + dx + gap + jitter[0]), float(j + dy + gap + jitter[1])))
    got = {tuple(r) for r in A.queen_neighbours(spark.createDataFrame(rows, "area_id long, x double, y double"), snap).collect()}
    want = {
        (a, b) for a, x, y in rows for b, u, v in rows
        if a != b and (x - u) * (x - u) + (y - v) * (y - v) <= snap * snap
    }
    assert got == want and 100 < len(want) < 220
    assert not any(55 in pair for pair in got)


def test_points_on_both_sides_of_a_cell_edge(spark):
    rows = [(1, 0.9999999, 0.0), (2, 1.0000001, 0.0), (3, 1.0000001, 2.0)]
    got = A.queen_neighbours(spark.createDataFrame(rows, "area_id long, x double, y double"), 1e-6).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1)]


def test_repeated_keys_raise_in_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10, None), (None, 30, "z")], "k int, n int, t string")
    got = sorted(map(tuple, G.left_join(left, right, "k").collect()), key=str)
    assert got == [(1, "a", 10, None), (2, "b", None, None), (None, "c", 30, "z")]
    with pytest.raises(Exception, match="k is not unique on the right side: 1"):
        G.left_join(left, right.union(right.limit(1)), "k").collect()
