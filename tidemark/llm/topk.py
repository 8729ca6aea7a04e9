"""Exact top-k search by MaxScore over shards of integer vectors.

A component is a query term: shifted by its bound in the shard, its contribution is never negative and has an upper bound.
The terms of a query are split by these bounds: the non-essential ones together can't lift a vector over the k-th best
score so far. Postings of essential terms are traversed for a block of vectors; the non-essential ones are probed, largest
bound first, only for vectors that can still compete. Shards' results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8_192  # vectors of a shard, about
QUERIES = 2_048  # queries of a block, about
BLOCK = 1_024  # vectors whose essential postings are traversed at a time
MOST = (1 << 63) - 1
PROBE = 8  # terms probed between two looks at who competes


def whole(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def max_score(q: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query over a shard. postings: one row a term, vectors sorted by id."""
    top = np.where(q >= 0, q * high, q * low)  # bound of each term's contribution
    floor = np.where(q >= 0, q * low, q * high)
    order = np.argsort(-(top - floor), kind="stable")
    rest = np.concatenate((np.cumsum(top[order][::-1])[::-1], [0]))  # bound of the terms from a place on
    best_scores, best_ids = np.zeros(0, q.dtype), np.zeros(0, np.int64)
    limit = None
    for at in range(0, len(ids), BLOCK):
        block = postings[:, at:at + BLOCK]
        if limit is None:
            essential = len(order)
        else:
            # the last terms whose gain over their least contribution can't make up a missing k-th score
            gain = np.concatenate((np.cumsum((top - floor)[order][::-1])[::-1], [0]))
            essential = int(np.argmax(gain + floor.sum() < limit)) if (gain + floor.sum() < limit).any() else len(order)
            if not essential:
                continue
        score = q[order[:essential]] @ block[order[:essential]]
        alive = np.arange(block.shape[1])
        done = essential
        while limit is not None and len(alive) and done <= len(order):
            keep = score + rest[done] >= limit
            alive, score = alive[keep], score[keep]
            if done == len(order):
                break
            step = order[done:done + PROBE]
            score = score + q[step] @ block[np.ix_(step, alive)]
            done = min(len(order), done + PROBE)
        names = ids[at:at + BLOCK][alive]
        other = names != own
        best_scores = np.concatenate((best_scores, score[other]))
        best_ids = np.concatenate((best_ids, names[other]))
        if len(best_ids) > k:
            first = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids = best_scores[first], best_ids[first]
        if len(best_ids) == k:
            limit = best_scores.min()
    return [(max(-MOST - 1, min(MOST, int(s))), int(i)) for s, i in zip(best_scores, best_ids)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of the highest integer inner product of
    floor(scale * component), ties to the smaller id; all if fewer.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part. A query meets vectors of
    its own number of components only, and never those of its own id. Repeated vectors are each a candidate; queries of one
    id count once, by their smallest vector. Integers and scores beyond a long stand at its ends. Query blocks meet shards of vectors, both of bounded size; no shard is left out.
    """
    def ints(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        exact = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.filter(F.col(id_col).isNotNull() & whole(v)).select(F.col(id_col).cast("long").alias("id"), exact.alias("v"), F.size(v).alias("dim"))

    base = ints(vectors)
    asked = ints(queries).groupBy("id", "dim").agg(F.min("v").alias("v"))
    shards = max(1, math.ceil(base.count() / SHARD))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    sides = base.select("dim", "id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query")).unionByName(
        asked.select("dim", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query")))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        is_query = frame["query"].to_numpy(dtype=bool)
        held, asking = frame[~is_query].sort_values("id", kind="stable"), frame[is_query]
        rows = []
        if len(held) and len(asking):
            c = np.array(held["v"].tolist(), dtype=np.int64)
            a = np.array(asking["v"].tolist(), dtype=np.int64)
            # doubles are exact below 2^53; beyond, Python's integers are
            most = float(np.abs(c.astype(float)).max()) * float(np.abs(a.astype(float)).max()) * c.shape[1]
            kind = np.float64 if most < 2 ** 52 else object
            postings = np.ascontiguousarray(c.T.astype(kind))
            high, low = postings.max(axis=1), postings.min(axis=1)
            ids = held["id"].to_numpy(dtype=np.int64)
            for q, own in zip(a.astype(kind), asking["id"]):
                rows += [(int(own), i, s) for s, i in max_score(q, int(own), ids, postings, high, low, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = sides.groupBy("dim", "shard", "block").applyInPandas(shard, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
