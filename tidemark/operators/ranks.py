"""Rolling ranks and robust scores over series of any length (bounded blocks, bounded frames)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import array_median, epoch, finite, rank_below, trailing, wilder
from tidemark.functions.order import sliding_rank
from tidemark.operators.windows import in_blocks, number_rows, with_halo


def wilder_rma(
    bars: DataFrame, column: str, period: int, keys: Sequence[str] = ("symbol",), tolerance: float = 1e-12
) -> DataFrame:
    """Wilder average of any column; NULL until `period` samples exist.

    A block looks back until what lies before weighs less than `tolerance`, however long the period.
    """
    lookback = period + (math.ceil(math.log(tolerance) / math.log((period - 1.0) / period)) if period > 1 else 0)

    def compute(df: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy("session_date", "ts")
        numbered = df.withColumn("_i", F.row_number().over(w) - 1)
        return numbered.withColumn(f"rma{period}", wilder(F.col(column), F.col("_i"), period, w)).drop("_i")

    return in_blocks(bars, keys, "session_date", ["ts"], lookback, compute, block_rows=max(512, min(2048, 30 * period)))


def percentile_rank(
    bars: DataFrame, column: str, window: int = 100, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Share of the last `window` finite values (current included) strictly below the current one."""

    def compute(df: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy("session_date", "ts")
        values = F.collect_list(finite(column)).over(trailing(w, window))
        return df.withColumn(f"{column}_rank", rank_below(values))

    return in_blocks(bars, keys, "session_date", ["ts"], window, compute)



def robust_zscore(
    bars: DataFrame, column: str, window: int = 500, min_samples: int = 20, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Score of each value against up to `window` earlier rows; a row never scores against itself."""

    def compute(df: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy("session_date", "ts")
        framed = df.withColumn("_h", F.collect_list(F.col(column).cast("double")).over(trailing(w, window, -1)))
        return framed.withColumn("_m", array_median(F.col("_h"))).withColumn(
            "_d", array_median(F.transform("_h", lambda v: F.abs(v - F.col("_m"))))
        ).withColumn(
            "robust_z",
            F.when(
                F.size("_h") >= min_samples,
                F.when(F.col("_d") > 0, (F.col(column) - F.col("_m")) / (1.4826 * F.nullif(F.col("_d"), F.lit(0.0)))).otherwise(0.0),
            ),
        ).drop("_h", "_m", "_d")

    return in_blocks(bars, keys, "session_date", ["ts"], window, compute)


def gex_rank(
    prints: DataFrame,
    column: str,
    max_age_days: float = 10.0,
    max_entries: int | None = None,
    min_samples: int = 30,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Rank of |net GEX| among the prints of the last `max_age_days` (the newest max_entries of them, if given), itself
    included; 0.5 until warm.

    Blocks are stretches of time of that length, each with the stretch before it, so a window is exact and a symbol is many
    tasks whatever its history; inside a block windows are counted over sorted runs. A null value counts in the window but
    ranks below nothing.
    """
    age = int(max_age_days * 86_400 * 1e6)
    micros, mag = F.unix_micros("ts"), F.abs(F.col(column)).cast("double")
    own = F.floor(micros / age)
    blocks = prints.withColumns({"_t": micros, "_m": mag}).withColumn("_blk", F.explode(F.array(own, own + 1))).withColumn("_core", F.col("_blk") == own)

    def rank(frame):
        import numpy as np

        frame = frame.sort_values("_t", kind="stable")
        n, below = sliding_rank(frame["_t"].to_numpy(), frame["_m"].fillna(np.inf).to_numpy(), age, 0, max_entries)
        known = frame["_m"].notna().to_numpy()
        out = frame.assign(n=n.astype("int32"), pct_rank=np.where(n < min_samples, 0.5, np.where(known, below, 0) / n))
        return out[out["_core"]].drop(columns=["_t", "_m", "_blk", "_core"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema.fields)
    return blocks.groupBy(*keys, "_blk").applyInPandas(rank, f"{fields}, n int, pct_rank double")


__all__ = ["gex_rank", "number_rows", "percentile_rank", "robust_zscore", "wilder_rma", "with_halo"]
