"""Least distances on a line: order against the general assignment by shortest paths."""

import numpy as np
import pytest

from tonelake.operators import truth


@pytest.mark.parametrize("seed", range(3))
def test_order_costs_as_little_as_the_general_assignment(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 40, 25), rng.integers(0, 60, 25)
    rows = lambda v: spark.createDataFrame([(7, i, int(x)) for i, x in enumerate(v)], "score_id long, ord int, at long")
    got = [(r["ord"], r["mate"]) for r in truth.least_distance(rows(a), rows(b)).collect()]
    cost = np.abs(a[:, None] - b[None, :]).astype(float)
    assert sorted(i for i, _ in got) == sorted(j for _, j in got) == list(range(25))
    assert sum(cost[i, j] for i, j in got) == sum(cost[i, j] for i, j in truth.least_cost(cost))


def test_long_scores_need_no_matrix(spark):
    """40,000 places: a matrix of their distances would hold 12.8 GB."""
    n = 40_000
    early = spark.range(n).selectExpr("1L AS score_id", "CAST(id AS INT) AS ord", "id * 240 AS at")
    late = early.selectExpr("score_id", "ord", "at + 299 AS at")
    assert truth.least_distance(early, late).where("ord = mate").count() == n
