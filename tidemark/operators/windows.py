"""Ordered computation over keys of any size, in tasks of bounded size.

`Window.partitionBy(symbol)` puts a symbol's whole history in one task. The helpers here number rows with a
two-level count (per chunk, then a prefix over chunks), cut the sequence in fixed blocks and copy the trailing
`lookback` rows of each block into the next ones, so a trailing window is exact inside a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str | Column], name: str = "_seq"
) -> DataFrame:
    """0-based position of each row within `keys`, ordered by (chunk, order).

    `chunk` must be monotone with `order` (a session date, an hour) and small enough for one task.
    """
    keys = list(keys)
    part = [*keys, chunk]
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    within = Window.partitionBy(*part).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(within) - 1)
        .join(offsets, part)
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_off", "_rn")
    )


def with_halo(numbered: DataFrame, lookback: int, block_rows: int, seq: str = "_seq") -> DataFrame:
    """Copy each row to its own block and to every later block whose trailing windows still reach it."""
    own = F.floor(F.col(seq) / block_rows)
    last = F.floor((F.col(seq) + lookback) / block_rows)
    return numbered.withColumn("_blk", F.explode(F.sequence(own, last))).withColumn("_core", F.col("_blk") == own)


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    lookback: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    block_rows: int = 2048,
) -> DataFrame:
    """Run `compute(frame, group_keys)` on bounded blocks and keep each row once.

    `compute` must keep the `_core` column and may only look `lookback` rows back.
    """
    blocks = with_halo(number_rows(df, keys, chunk, order), lookback, block_rows)
    out = compute(blocks, [*keys, "_blk"])
    return out.filter("_core").drop("_core", "_blk", "_seq")


def running_offsets(
    df: DataFrame, keys: Sequence[str], chunk: str, totals: dict[str, Column]
) -> DataFrame:
    """Per (keys, chunk): the sum of each total over all earlier chunks (0 for the first)."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(*[v.alias(k) for k, v in totals.items()])
    return sums.select(
        *keys, chunk, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in totals]
    )


def grouped_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): exact median of the known values, the mean of the middle pair where their number is even.

    Two approximate quantiles beside the middle cut a group in three; counts say which part holds the middle, whatever the
    error of the cuts, and only the distinct values of that part are sorted. All counts are combined before the shuffle. For
    few groups of any size (features, dimensions): three numbers a group are broadcast.
    """
    keys, v = list(keys), F.col(value)
    known = df.select(*keys, value).filter(v.isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx(value, [0.499, 0.501], 10_000).alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    placed = known.join(F.broadcast(cuts.withColumnsRenamed({k: f"_of_{k}" for k in keys})), same or F.lit(True)).select(
        *keys, value, F.when(v < F.col("_cuts")[0], 0).when(v > F.col("_cuts")[1], 2).otherwise(1).alias("_b"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = sizes.filter((F.col("_off") < high) & (F.col("_off") + F.col("_n") >= low))
    here = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_b"]]
    few = placed.join(F.broadcast(middle.drop("_n").withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_b"]})), here)
    counts = few.groupBy(*keys, "_b", value, "_off", "_all").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_off") + F.sum("_n").over(upto)
    held = counts.select(*keys, value, "_n", "_all", last.alias("_last"))
    holds = lambda rank: F.max(F.when((F.col("_last") >= rank) & (F.col("_last") - F.col("_n") < rank), v))
    return held.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias(name))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    name: str = "rank",
    buckets: int = 64,
) -> DataFrame:
    """Exact 1-based ascending rank within `keys` plus the group size `n`, without one task per group.

    Rows are spread over value ranges cut at approximate quantiles; rank = rows in lower ranges + position in the
    range. Rows of one repeated value are spread by a hash of `tie` inside that value's range, so the order is by
    value, then by a fixed hash order of the tie columns, and a value shared by a third of all rows still splits.
    """
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts")
    )
    spread = F.pmod(F.xxhash64(*tie), F.lit(16)).cast("int")
    v = F.col(value)
    placed = (
        df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    ).select(
        *df.columns,
        F.size(F.filter("_cuts", lambda q: q < v)).alias("_b"),
        F.when(F.array_contains("_cuts", v), spread).otherwise(F.lit(0)).alias("_s"),
        F.array_contains("_cuts", v).cast("int").alias("_eq"),
    )
    part = [*keys, "_b", "_eq", "_s"]
    order = Window.partitionBy(*keys).orderBy("_b", "_eq", "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = (
        placed.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("n"))
    )
    within = Window.partitionBy(*part).orderBy(v, *tie)
    return (
        placed.withColumn("_rn", F.row_number().over(within))
        .join(sizes, part)
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_b", "_eq", "_s", "_off", "_rn")
    )


def chunked_lag(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """`lag` over (keys ordered by chunk, order) without one task per key: {source column: output name}.

    The first row of a chunk takes the last row of the previous non-empty chunk.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    carried = Window.partitionBy(*keys).orderBy(chunk)
    last = df.groupBy(*keys, chunk).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_end"))
    prev = last.select(*keys, chunk, F.lag("_end").over(carried).alias("_prev"))
    local = df.select("*", F.row_number().over(w).alias("_rn"), F.lag(F.struct(*columns)).over(w).alias("_lag"))
    source = F.when(F.col("_rn") == 1, F.col("_prev")).otherwise(F.col("_lag"))
    return local.join(prev, [*keys, chunk]).select(
        *df.columns, *[source[c].alias(out) for c, out in columns.items()]
    )


def chunked_running_sum(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Running sums over (keys ordered by chunk, order): {source column: output name}."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = running_offsets(df, keys, chunk, {c: F.sum(c) for c in columns})
    local = df.select("*", *[F.sum(c).over(w).alias(f"_run_{c}") for c in columns])
    return local.join(offsets, [*keys, chunk]).select(
        *df.columns, *[(F.col(f"_run_{c}") + F.col(f"{c}_before")).alias(out) for c, out in columns.items()]
    )


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, fresh, out_schema: str) -> DataFrame:
    """Sequential rule per key in constant memory: rows arrive sorted, `step(state, row) -> tuple` may change state.

    Each key's rows lie in one sorted partition and stream through in Arrow batches, so memory does not depend on
    the size of a key. Only for rules whose next result depends on the results before.
    """
    keys = list(keys)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(None if (x := getattr(row, k)) != x else x for k in keys)  # a null may arrive as NaN
                if key != current:
                    current, state = key, fresh()
                out.append(step(state, row))
            yield pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    names = [part.strip().split(" ")[0] for part in out_schema.split(",")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + out_schema
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
