"""Technical indicators as window expressions over bounded groups of bars.

Every field is the state at one bar given the bars before it in its group. NULL means "not enough history",
never 0. `indicator_frame` works on groups that are small by construction (the bars of one snapshot, one block);
`indicators` runs it over series of any length through overlapping blocks. Unused fields are pruned by Catalyst,
so each public operator is a narrow select over the same frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import array_median, clip, ema, finite, rank_below, ratio, trailing, wilder
from tidemark.operators.bars import DEFAULT_TIMEFRAMES, ET, resample_many, timeframe_label
from tidemark.operators.windows import in_blocks

LOOKBACK = 420  # bars a snapshot carries
RANK = 100

FIELDS = (
    "last_return", "dist_to_vwap", "vwap_slope", "range_position",
    "adx", "plus_di", "minus_di", "di_spread", "ema_slope", "rsi", "bb_compression", "trend_cleanliness",
    "realized_vol", "rv_expansion", "cvd_persistence",
    "bb_width", "bb_position", "bb_squeeze", "bb_expansion",
    "keltner_width", "keltner_position", "keltner_trend_strength",
    "donchian_width", "donchian_position", "donchian_breakout_up", "donchian_breakout_down",
)


def indicator_frame(bars: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bars plus every indicator field, `true_range`, `atr`, `ema20`, `signed_volume` and `n_bars`."""
    keep = list(bars.columns)
    w = Window.partitionBy(*group).orderBy("session_date", "ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    col = F.col

    raw = bars.select(
        *keep,
        (F.row_number().over(w) - 1).alias("i"),
        F.lag("close").over(w).alias("pc"),
        F.lag("high").over(w).alias("ph"),
        F.lag("low").over(w).alias("pl"),
        F.max((col("close") <= 0).cast("int")).over(trailing(w, LOOKBACK)).alias("bad_close"),
    )
    up, down = col("high") - col("ph"), col("pl") - col("low")
    move = col("close") - col("pc")
    span = col("high") - col("low")
    steps = raw.select(
        "*",
        (col("i") + 1).alias("n_bars"),
        (col("i") - 1).alias("j"),  # position in series that start at the second bar
        F.when(
            col("i") >= 1,
            F.greatest(span, F.abs(col("high") - col("pc")), F.abs(col("low") - col("pc"))),
        ).alias("true_range"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("pdm"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("mdm"),
        F.when(move > 0, move).otherwise(0.0).alias("gain"),
        F.when(move < 0, -move).otherwise(0.0).alias("loss"),
        F.when((col("close") > 0) & (col("pc") > 0), F.ln(col("close") / col("pc"))).alias("ret"),
        (F.when(span > 0, 2.0 * (col("close") - col("low")) / span - 1.0).otherwise(0.0) * col("volume")).alias(
            "signed_volume"
        ),
    )
    t20, t5 = trailing(w, 20), trailing(w, 5)
    v = col("volume").cast("double")
    first = steps.select(
        "*",
        wilder(col("true_range"), col("j"), 14, w).alias("atr"),
        wilder(col("true_range"), col("j"), 20, w).alias("atr20"),
        wilder(col("pdm"), col("j"), 14, w).alias("pdm14"),
        wilder(col("mdm"), col("j"), 14, w).alias("mdm14"),
        wilder(col("gain"), col("j"), 14, w).alias("gain14"),
        wilder(col("loss"), col("j"), 14, w).alias("loss14"),
        ema(col("close"), col("i"), 20, w).alias("ema20"),
        F.when(col("i") >= 19, F.avg("close").over(t20)).alias("mid"),
        F.when(col("i") >= 19, F.stddev_pop("close").over(t20)).alias("sd"),
        F.when(col("i") >= 20, F.stddev_pop("ret").over(t20)).alias("rv20"),
        F.when(col("i") >= 5, F.stddev_pop("ret").over(t5)).alias("rv5"),
        F.regr_r2("close", col("i").cast("double")).over(t20).alias("r2"),
        F.max("high").over(t20).alias("hi20"),
        F.min("low").over(t20).alias("lo20"),
        F.max("high").over(trailing(w, 20, -1)).alias("prior_hi"),
        F.min("low").over(trailing(w, 20, -1)).alias("prior_lo"),
        F.sum(v).over(t20).alias("v20"),
        F.sum(col("close") * v).over(t20).alias("cv20"),
        F.coalesce(F.sum(v).over(trailing(w, 19, -1)), F.lit(0.0)).alias("v19"),
        F.sum(col("close") * v).over(trailing(w, 19, -1)).alias("cv19"),
        F.sum("signed_volume").over(t5).alias("sv5"),
        F.avg(v).over(t5).alias("avg_v5"),
    )
    half = 1.5 * col("atr20")
    k_ok = (col("atr20") > 0)
    dx = 100.0 * F.abs(ratio(100.0 * col("pdm14"), col("atr")) - ratio(100.0 * col("mdm14"), col("atr")))
    dx = F.try_divide(dx, ratio(100.0 * col("pdm14"), col("atr")) + ratio(100.0 * col("mdm14"), col("atr")))
    second = first.select(
        "*",
        ratio(100.0 * col("pdm14"), col("atr")).alias("pdi"),
        ratio(100.0 * col("mdm14"), col("atr")).alias("mdi"),
        F.coalesce(finite(dx), F.lit(0.0)).alias("dx"),
        finite(ratio(4.0 * col("sd"), col("mid"))).alias("bw"),
        F.when(col("i") >= 1, F.when(col("ema20") > 0, 2.0 * half / col("ema20"))).alias("kw"),
        F.when(half > 0, (col("close") - (col("ema20") - half)) / (2.0 * half)).alias("kpos"),
        F.when(col("i") >= 19, finite(ratio(col("hi20") - col("lo20"), col("close")))).alias("dw"),
    )
    frame = trailing(w, RANK)
    third = second.select(
        "*",
        wilder(col("dx"), col("j"), 14, w).alias("adx14"),
        F.lag("ema20", 5).over(w).alias("ema_back"),
        F.lag("bw", 5).over(w).alias("bw_back"),
        array_median(F.collect_list("bw").over(t20)).alias("bw_med"),
        rank_below(F.collect_list("bw").over(frame)).alias("bw_rank"),
        rank_below(F.collect_list("rv20").over(frame)).alias("rv_rank"),
        rank_below(F.collect_list("kw").over(frame)).alias("kw_rank"),
        rank_below(F.collect_list("dw").over(frame)).alias("dw_rank"),
        F.avg(col("kpos") - 0.5).over(trailing(w, 10)).alias("ktrend"),
    )
    n = col("n_bars")
    vwap = col("cv20") / col("v20")
    prior_vwap = F.when(col("v19") > 0, col("cv19") / col("v19"))
    vw_ok = (n >= 2) & (col("v20") > 0) & (col("close") > 0)
    bb_ok = (n >= 20) & col("bw").isNotNull() & (col("mid") > 0)
    clean = F.coalesce(col("bad_close"), F.lit(0)) == 0
    d_ok = (n >= 21) & (col("hi20") > col("lo20")) & (col("close") > 0)
    return third.select(
        *keep,
        "n_bars",
        "true_range",
        "atr",
        "ema20",
        "signed_volume",
        F.when(col("pc") != 0, col("close") / col("pc") - 1.0).alias("last_return"),
        F.when(vw_ok, (col("close") - vwap) / col("close") * 100.0).alias("dist_to_vwap"),
        F.when(
            vw_ok, F.coalesce(F.when(prior_vwap > 0, (vwap - prior_vwap) / prior_vwap * 100.0), F.lit(0.0))
        ).alias("vwap_slope"),
        F.when(col("hi20") > col("lo20"), (col("close") - col("lo20")) / (col("hi20") - col("lo20"))).alias(
            "range_position"
        ),
        F.when((n >= 28), col("adx14")).alias("adx"),
        F.when(n >= 28, col("pdi")).alias("plus_di"),
        F.when(n >= 28, col("mdi")).alias("minus_di"),
        F.when(n >= 28, col("pdi") - col("mdi")).alias("di_spread"),
        F.when(
            (n >= 25) & (col("ema_back") != 0),
            (col("ema20") - col("ema_back")) / col("ema_back") * 100.0 / 5.0,
        ).alias("ema_slope"),
        F.when(
            n >= 15,
            F.when(col("loss14") <= 0, F.when(col("gain14") > 0, 100.0).otherwise(50.0)).otherwise(
                100.0 - 100.0 / (1.0 + col("gain14") / F.nullif(col("loss14"), F.lit(0.0)))
            ),
        ).alias("rsi"),
        F.when((n >= 40) & (col("bw_med") > 0), col("bw") / col("bw_med")).alias("bb_compression"),
        F.when((n >= 20) & (col("sd") > 0), finite(col("r2"))).alias("trend_cleanliness"),
        F.when((n >= 22) & clean, col("rv_rank")).alias("realized_vol"),
        F.when((n >= 22) & clean & (col("rv20") > 0), col("rv5") / F.nullif(col("rv20"), F.lit(0.0)) - 1.0).alias("rv_expansion"),
        F.when(
            n >= 6, col("sv5") / (F.when(col("avg_v5") > 0, col("avg_v5")).otherwise(1.0) * 5.0)
        ).alias("cvd_persistence"),
        F.when(bb_ok, col("bw_rank")).alias("bb_width"),
        F.when(bb_ok & (col("sd") > 0), (col("close") - (col("mid") - 2.0 * col("sd"))) / F.nullif(4.0 * col("sd"), F.lit(0.0))).alias(
            "bb_position"
        ),
        F.when(
            bb_ok & (col("kw") > 0) & k_ok, clip((1.0 - ratio("bw", "kw")) / (1.0 - 0.6), 0.0, 1.0)
        ).alias("bb_squeeze"),
        F.when(bb_ok & (n >= 25) & (col("bw_back") > 0), col("bw") / F.nullif(col("bw_back"), F.lit(0.0)) - 1.0).alias("bb_expansion"),
        F.when(k_ok, col("kw_rank")).alias("keltner_width"),
        F.when(k_ok, col("kpos")).alias("keltner_position"),
        F.when(k_ok, col("ktrend")).alias("keltner_trend_strength"),
        F.when(d_ok, col("dw_rank")).alias("donchian_width"),
        F.when(d_ok, (col("close") - col("lo20")) / (col("hi20") - col("lo20"))).alias("donchian_position"),
        F.when((n >= 21) & k_ok, F.greatest(F.lit(0.0), (col("close") - col("prior_hi")) / col("atr20"))).alias(
            "donchian_breakout_up"
        ),
        F.when((n >= 21) & k_ok, F.greatest(F.lit(0.0), (col("prior_lo") - col("close")) / col("atr20"))).alias(
            "donchian_breakout_down"
        ),
    )


def indicators(bars: DataFrame, keys: Sequence[str] = ("symbol",), block_rows: int = 2048) -> DataFrame:
    """`indicator_frame` over whole series, in blocks that overlap by the snapshot look-back.

    Recursive averages start at the block's first halo row; after 420 bars a Wilder or EMA seed weighs < 1e-9.
    """
    return in_blocks(bars, keys, "session_date", ["ts"], LOOKBACK, indicator_frame, block_rows)


def _pick(bars: DataFrame, keys: Sequence[str], *fields: str) -> DataFrame:
    return indicators(bars, keys).select(*keys, "session_date", "ts", *fields)


def true_range_atr(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "true_range", "atr")


def ema_series(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "ema20")


def adx(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "adx", "plus_di", "minus_di", "di_spread")


def rsi(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "rsi")


def ema_slope(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "ema_slope")


def bb_compression(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "bb_compression")


def trend_r_squared(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "trend_cleanliness")


def realized_vol_rank(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "realized_vol")


def rv_expansion(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "rv_expansion")


def rolling_vwap(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "dist_to_vwap", "vwap_slope")


def range_position(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "range_position")


def signed_volume(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Close-location share of the bar's volume; a row expression, no window."""
    span = F.col("high") - F.col("low")
    clv = F.when(span > 0, 2.0 * (F.col("close") - F.col("low")) / span - 1.0).otherwise(0.0)
    return bars.select(*keys, "session_date", "ts", (clv * F.col("volume")).alias("signed_volume"))


def cvd_slope(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "cvd_persistence")


def bollinger(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "bb_width", "bb_position", "bb_expansion")


def keltner(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(bars, keys, "keltner_width", "keltner_position", "keltner_trend_strength", "bb_squeeze")


def donchian(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _pick(
        bars, keys, "donchian_width", "donchian_position", "donchian_breakout_up", "donchian_breakout_down"
    )


def mtf_matrix(
    bars_1m: DataFrame,
    timeframes: Sequence[int] = DEFAULT_TIMEFRAMES,
    keys: Sequence[str] = ("symbol",),
    tz: str | None = ET,
) -> DataFrame:
    """Native indicators at every timeframe, one row per (keys, timeframe, bar). Never one value copied across."""
    every = resample_many(bars_1m, timeframes, keys, tz)
    return indicators(every, [*keys, "timeframe"])


def mtf_latest(
    snapshot_bars: DataFrame, timeframes: Sequence[int] = DEFAULT_TIMEFRAMES, tz: str | None = ET, placed: bool = False
) -> DataFrame:
    """The matrix at each snapshot, from the bars that snapshot carries (at most 420 rows per snapshot).

    Bars move once, by snapshot; timeframes, indicators and the last row are then made where they lie. placed: bars lie by
    snapshot already and don't move.
    """
    every = resample_many(snapshot_bars if placed else snapshot_bars.repartition("snapshot_id"), timeframes, ["snapshot_id"], tz)
    group = ["snapshot_id", "timeframe"]
    full = indicator_frame(every, group)
    return full.groupBy(*group).agg(
        F.max_by(F.struct("n_bars", *FIELDS), F.struct("session_date", "ts")).alias("f")
    ).select(*group, "f.*")


def mtf_feature_map(matrix: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long (ids, name, value) rows named `<timeframe>.<field>`; unknown values are absent, not 0."""
    return (
        matrix.select(*ids, timeframe_label("timeframe").alias("_tf"), *FIELDS)
        .unpivot([*ids, "_tf"], list(FIELDS), "_field", "value")
        .filter(F.col("value").isNotNull())
        .select(*ids, F.concat_ws(".", "_tf", "_field").alias("name"), "value")
    )


def mtf_packed(matrix: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """`mtf_feature_map` as one array of (name, value) structs a key: (key, kv)."""
    every = F.array(*[F.struct(F.concat_ws(".", "_tf", F.lit(f)).alias("name"), F.col(f).alias("value")) for f in FIELDS])
    known = matrix.withColumn("_tf", timeframe_label("timeframe")).select(key, F.filter(every, lambda x: x["value"].isNotNull()).alias("_kv"))
    return known.groupBy(key).agg(F.flatten(F.collect_list("_kv")).alias("kv"))
