"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters the rows uniformly into buckets of bounded bytes by a seeded hash of a row number, and writes them. Pass
two brings each bucket together, shuffles it (`shuffle` is a Fisher-Yates shuffle of an array), and gives every row its
place in the whole order; place modulo the shard count is the shard, so shards differ by one row at most (law `rows`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, written

BUCKET_BYTES = 16 << 20
MOST_BROADCAST = 500_000  # buckets whose offsets (16 bytes each) are broadcast; beyond, they are joined by a shuffle


def shard(docs: DataFrame, shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = 42, text_col: str = "text") -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 within the shard); columns of these names are replaced.

    Every row counts by itself: null and repeated texts and ids, and a third of the rows alike, change nothing, as the
    bucket depends on the row number only. One row is the smallest unit of a bucket, so a text beyond bucket_bytes makes
    its bucket larger. The written table fixes row numbers and hashes, so a lost executor changes no bucket. An empty table
    gives an empty one.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    key, size, bucket, base, row, at = (fresh(docs, c) for c in ("__key", "__size", "__bucket", "__base", "__row", "__at"))
    rows = written(docs.withColumns({
        key: F.xxhash64(F.lit(seed), F.monotonically_increasing_id()),
        size: F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1,
    }), "scattered")
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = rows.withColumn(bucket, F.pmod(F.col(key), F.lit(buckets)))

    # running counts over buckets in two levels, so that no task orders more than a thousandth of them
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col(bucket) / 1024))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", before(Window.orderBy("group")).alias("start"))
    offsets = counts.join(groups, "group").select(
        F.col(bucket), (F.col("start") + before(Window.partitionBy("group").orderBy(bucket))).alias(base))
    offsets = F.broadcast(offsets) if buckets <= MOST_BROADCAST else offsets

    record = F.struct(F.col(key), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    together = rows.join(offsets, bucket).repartition(buckets, bucket).groupBy(bucket, base).agg(F.collect_list(record).alias(row))
    # an order that does not depend on arrival, then Fisher-Yates
    order = F.array_sort(row, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))
    placed = together.select(base, F.posexplode(F.shuffle(order, F.lit(seed))).alias(at, row))
    place = F.col(base) + F.col(at)
    return placed.select(
        *[F.col(f"{row}.{row}.`{c}`").alias(c) for c in docs.columns],
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each bucket adds a file in its shuffled order."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
