"""Exact neighbours by rings against all pairs, and how many pairs they compare."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def clustered(n: int, seed: int = 6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 6)) * 10
    z = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 6)) * 0.3
    z[: n // 5] = z[0]  # one point repeated
    return z


def test_rings_equal_all_pairs_and_prune(spark):
    from tidemark.operators.forecast import NeighbourIndex, mean_nearest

    pairs = {}
    for n in (1_000, 4_000):
        z = clustered(n)
        rows = spark.createDataFrame([(k, z[k].tolist()) for k in range(n)], "id long, z array<double>").repartition(4)
        index = NeighbourIndex(rows, pivots=16 if n == 1_000 else 32, block_rows=64)
        sizes = index.blocks.select("cell", "ring", "salt", F.size("t_ids").alias("t"))
        for same in (True, False):
            got = {r.id: r for r in mean_nearest(index.search(rows, 5, same)).collect()}
            d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)) if n == 1_000 else None
            if d is not None:
                if same:
                    np.fill_diagonal(d, np.inf)
                best = np.sort(d, axis=1)[:, :5]
                assert np.allclose([got[k].mean_distance for k in range(n)], best.mean(axis=1), atol=1e-9)
                assert np.allclose([got[k].nearest_distance for k in range(n)], best[:, 0], atol=1e-9)
            assert len(got) == n
        seen = index.visits(rows, 5, False).join(sizes, ["cell", "ring", "salt"])
        pairs[n] = seen.agg(F.sum(F.size("q_ids") * F.col("t"))).first()[0]
    assert pairs[4_000] < 4_000**2 / 3 and pairs[4_000] / pairs[1_000] < 14


def test_few_or_no_rows(spark):
    from tidemark.operators.forecast import knn_distance

    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, z array<double>")
    assert {(r.id, r.mean_distance) for r in knn_distance(rows, rows, 5, exclude_self=True).collect()} == {(1, 5.0), (2, 5.0)}
    assert knn_distance(rows, rows.filter("id > 5")).count() == 0


def test_queries_move_once_however_many_blocks_they_meet(spark):
    """Points without clusters: every pack meets every block, and neither is copied for it."""
    from tidemark.operators.forecast import NeighbourIndex

    n, rng = 3_000, np.random.default_rng(3)
    z = rng.normal(size=(n, 8))
    z[:900] = z[0]  # more equal rows than a block holds
    rows = spark.createDataFrame([(k, z[k].tolist()) for k in range(n)], "id long, z array<double>").repartition(4)
    index = NeighbourIndex(rows, pivots=6, block_rows=200)
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
    for queries, same in ((rows, False), (rows, True), (None, True)):
        if same:
            np.fill_diagonal(d, np.inf)
        found = index.search(queries, 5, same)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        # packs, the rows of a ring (a number), and the answers; the training rows' own blocks don't move at all
        assert plan.count("Exchange hashpartitioning") == (1 if queries is None else 3), plan
        assert "SortMergeJoin" not in plan
        got = {r.id: r.best for r in found.collect()}
        assert np.allclose([got[k] for k in range(n)], np.sort(d, axis=1)[:, :5], atol=1e-9)
