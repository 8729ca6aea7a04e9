"""Search and near duplicates of vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import ordered
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def table(seed: int = 1) -> list[tuple]:
    """Pairs, copies, a group whose lists saturate, other lengths, and vectors that are null, zero or not finite."""
    rng = np.random.default_rng(seed)
    rows = [x.tolist() for x in rng.standard_normal((300, 16))]
    for k in range(20):
        rows.append((np.array(rows[k]) + 0.15 * rng.standard_normal(16)).tolist())
    rows += [rows[5]] * 4
    centre = rng.standard_normal(16)
    rows += [(centre + 0.12 * rng.standard_normal(16)).tolist() for _ in range(90)]
    rows += [None, [], [0.0] * 16, [1.0] * 15 + [math.nan], [1.0] * 15 + [math.inf], [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.1], [3e30] * 16, [1e-30] * 16]
    out = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0) for k, v in enumerate(rows)]
    return [*out, out[7]]


def valid(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def links_brute(rows: list[tuple], threshold: float = 0.9) -> list[tuple]:
    n = len(rows)
    ok = [valid(r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.abs(r[1]).max() if o else None for r, o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    up, degree = list(range(n)), [0] * n

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                degree[i] += 1
                degree[j] += 1
                up[find(i)] = find(j)
    low: dict[int, int] = {}
    for i in range(n):
        low[find(i)] = min(rows[i][0], low.get(find(i), rows[i][0]))
    return [(rows[i][0], degree[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n)]


def test_near_duplicates(spark):
    from tidemark.llm.neighbours import near_duplicates

    got = near_duplicates(spark.createDataFrame(table(), SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert ordered(got) == ordered(links_brute(table()))


def test_descent_alone_finds_most_links(spark):
    """Few seeding tables: the rounds of the descent must add links that the seeding missed."""
    from pyspark.sql import functions as F

    from tidemark.llm import neighbours

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = [(k, (c + 0.25 * rng.standard_normal(16)).tolist()) for k, c in enumerate(np.repeat(centres, 60, axis=0))]
    points = spark.createDataFrame(x, "id long, v array<double>")
    first = neighbours.shortest(neighbours.seeded(points, 50_000, 16, 2, 1), 16)
    second = neighbours.shortest(first.union(neighbours.refined(first, points, 16)), 16)
    strong = F.col("sim") >= 0.9
    assert second.filter(strong).count() > first.filter(strong).count() > 0


def test_links_between_classes_of_full_lists(spark, monkeypatch):
    """Two tight groups with one link between them, whose ends have more nearer partners than a list holds. The audit,
    which would see every point of a table this small, sees none."""
    from tidemark.llm import neighbours

    real = neighbours.audit
    monkeypatch.setattr(neighbours, "audit", lambda points, threshold, *rest: real(points, threshold, 0))
    rng = np.random.default_rng(6)
    at = lambda degrees: np.array([math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), *[0.0] * 14])
    angles = [0] * 40 + [4] + [32] * 30 + [28]  # the link is 24 degrees, all other pairs across are 28 or more
    rows = [(k, (at(d) + 0.002 * rng.standard_normal(16)).tolist(), 0) for k, d in enumerate(angles)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()
    rows = [(r[0], [float(np.float32(x)) for x in r[1]], 0) for r in rows]
    want = links_brute(rows)
    assert {r[2] for r in want} == {0} and want[40][1] == 41
    assert ordered(got) == ordered(want)


def test_links_that_no_attempt_finds_are_found_by_comparing_all(spark, monkeypatch):
    """The seeding finds nothing and the audit sees few points: the last attempt is short, so all points are compared."""
    from tidemark.llm import neighbours

    monkeypatch.setattr(neighbours, "seeded", lambda points, *rest: points.sparkSession.createDataFrame([], neighbours.PAIRS))
    monkeypatch.setattr(neighbours, "AUDIT_SMALL", 60, raising=False)
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(neighbours, "WHOLE", 100, raising=False)
    got = neighbours.near_duplicates(spark.createDataFrame(table(), SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert ordered(got) == ordered(links_brute(table()))


def test_tables_grow_with_the_points():
    from tidemark.llm.neighbours import tables_for

    assert [tables_for(n, 0.9, 16) for n in (0, 100, 10**6, 10**8)] == [16, 16, 28, 86]


@pytest.mark.parametrize("k", [5, 1000])
def test_search(spark, monkeypatch, k):
    from tidemark.llm import topk

    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "BLOCK", 32)
    rows = [*table(), (50 * 400, [0.01] * 16, 0), (50 * 401, [0.01] * 16, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.search(df, df.filter("vec_id % 50 = 0"), k=k).select("query_id", "rank", "vec_id", "score").collect()
    ints = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows if valid(r[1])]
    want = []
    for q, a in {i: v for i, v in ints if i % 50 == 0}.items():
        scored = sorted(((max(-(1 << 63), min(1 << 63, -sum(x * y for x, y in zip(a, b)))), i) for i, b in ints if i != q and len(a) == len(b)))[:k]
        want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scored)]
    assert ordered(got) == ordered(want)


def test_empty_vectors(spark):
    from tidemark.llm.neighbours import near_duplicates
    from tidemark.llm.topk import search

    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and search(none, none).collect() == []
