"""Dominance pruning over all families against all pairs, and the pairs it compares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def beaten(points):
    area = points[:, 1:].sum(axis=1)
    ge = (points[:, None, :] >= points[None, :, :]).all(axis=2)
    return (ge & (area[:, None] > area[None, :])).any(axis=0)


def test_all_families_equal_all_pairs(spark):
    from tidemark.operators import structures as S
    from tidemark.plans import adapters as A

    chain = A.options(spark, "/root/testdata/sf0.001").filter(F.col("snapshot_id").isin("1995-03", "1996-07"))
    every = S.dedupe_by_payoff(S.dedupe_by_geometry(S.candidate_universe(chain, dominance=False)))
    assert every.select("family").distinct().count() >= 10  # the rare ones need other chains
    kept = {(r.snapshot_id, r.candidate_id) for r in S.drop_dominated(every, block_rows=100).select("snapshot_id", "candidate_id").collect()}
    want = set()
    for snapshot, part in S.payoff_rows(every).toPandas().groupby("snapshot_id"):
        gone = beaten(S.payoff_points(part))
        want |= {(snapshot, c) for c, g in zip(part["candidate_id"], gone) if not g}
    assert kept == want and 0 < len(kept) < every.count()


def test_pairs_stay_far_below_the_square():
    from tidemark.operators.structures import maximal_rows

    rng = np.random.default_rng(2)
    for n in (4_000, 16_000):
        base = rng.integers(0, 1000, size=(n, 1))
        points = base + rng.integers(0, 60, size=(n, 12))
        kept, pairs = maximal_rows(points, points[:, 1:].sum(axis=1))
        few = points[:4_000] if n == 4_000 else None
        if few is not None:
            assert kept == np.flatnonzero(~beaten_in_parts(few)).tolist()
        assert pairs < n * n / 40


def beaten_in_parts(points):
    return np.concatenate([
        ((points[:, None, :] >= points[None, i:i + 100, :]).all(axis=2) & (points[:, None, 1:].sum(axis=2) > points[None, i:i + 100, 1:].sum(axis=2))).any(axis=0)
        for i in range(0, len(points), 100)])


def test_repeated_points_stay_together():
    from tidemark.operators.structures import maximal_rows

    points = np.array([[1, 2, 3], [1, 2, 3], [0, 2, 3], [0, 2, 2], [5, 0, 0]])
    assert maximal_rows(points, points[:, 1:].sum(axis=1), chunk=2)[0] == np.flatnonzero(~beaten(points)).tolist()
