"""Queries: bars and per-series indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.operators import ranks as R
from tidemark.plans import adapters as A
from tidemark.plans.registry import query

def ohlcv() -> list:
    return [r6("open", "open"), r6("high", "high"), r6("low", "low"), r6("close", "close"), "volume"]

OHLCV_SQL = (
    "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"
)


def keyed(df: DataFrame, *fields: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.select(*keys, F.unix_timestamp("ts").alias("ts_sec"), *[r6(f, f) for f in fields])


# -- bars ------------------------------------------------------------------------------------------------------
@query("tick_bars_30m", A.sql(f"SELECT symbol, epoch(ts)::BIGINT AS ts_sec, {OHLCV_SQL} FROM v_bars30", "v_bars30"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.bars(spark, sf).select("symbol", F.unix_timestamp("ts").alias("ts_sec"), *ohlcv())


@query("resample_ohlcv", A.sql(f"SELECT symbol, epoch(ts)::BIGINT AS ts_sec, {OHLCV_SQL} FROM v_bars60", "v_bars60"))
def _(spark, sf):
    one_minute = A.bars(spark, sf, 1)
    return B.resample_ohlcv(one_minute, 60, tz=None).select("symbol", F.unix_timestamp("ts").alias("ts_sec"), *ohlcv())


@query(
    "resample_all_timeframes",
    A.sql(
        """
    SELECT symbol, tf AS timeframe,
           CASE tf WHEN 1 THEN '1m' WHEN 5 THEN '5m' WHEN 15 THEN '15m' WHEN 30 THEN '30m' WHEN 60 THEN '1h'
                   WHEN 240 THEN '4h' ELSE '1d' END AS label,
           count(*) AS n_bars, round(sum(close), 4) AS sum_close, round(sum(high - low), 4) AS sum_range
    FROM (SELECT symbol, tf, ts::DATE AS d,
                 CASE WHEN tf = 1440 THEN 0 ELSE floor((hour(ts) * 60 + minute(ts) - 570) / tf::DOUBLE) END AS b,
                 last(price ORDER BY ts, seq) AS close, max(price) AS high, min(price) AS low
          FROM v_ticks, (SELECT unnest([1, 5, 15, 30, 60, 240, 1440]) AS tf) GROUP BY ALL)
    GROUP BY symbol, tf""",
        "v_ticks",
    ),
)
def _(spark, sf):
    every = B.resample_many(A.bars(spark, sf, 1), tz=None)
    return every.groupBy("symbol", "timeframe").agg(
        F.first(B.timeframe_label("timeframe")).alias("label"),
        F.count(F.lit(1)).alias("n_bars"),
        F.round(F.sum("close"), 4).alias("sum_close"),
        F.round(F.sum(F.col("high") - F.col("low")), 4).alias("sum_range"),
    )


@query(
    "normalize_vendor_bars",
    A.sql(
        """
    SELECT symbol, epoch(ts)::BIGINT AS ts_sec, round(close, 6) AS close, volume FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM (
        SELECT symbol, date_trunc('minute', ts) AS ts, last(value ORDER BY seq) AS close,
               last(vol ORDER BY seq) AS volume
        FROM (SELECT event_type AS symbol, ts, value, event_id AS seq,
                     CASE WHEN user_id % 9 = 0 THEN 0 ELSE user_id % 20 - 1 END AS vol FROM events)
        WHERE value - 5 > 0 AND vol >= 0 GROUP BY symbol, date_trunc('minute', ts)))
    WHERE rn <= 8000"""
    ),
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    v = F.col("value")
    raw = e.select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("minute", "ts").alias("ts"),
        v.alias("open"), v.alias("high"), (v - 5).alias("low"), v.alias("close"),
        F.when(F.col("user_id") % 9 != 0, F.col("user_id") % 20 - 1).alias("volume"),
        F.col("event_id").alias("arrival"),
    )
    return B.normalize_vendor_bars(raw, max_bars=8_000).select(
        "symbol", F.unix_timestamp("ts").alias("ts_sec"), r6("close", "close"), "volume"
    )


@query(
    "merge_tick_bars",
    A.sql(
        """
    SELECT symbol, epoch(ts)::BIGINT AS ts_sec, round(close, 6) AS close FROM (
      SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY seq) AS close
      FROM v_ticks GROUP BY symbol, date_trunc('hour', ts))""",
        "v_ticks",
    ),
)
def _(spark, sf):
    p = F.col("price")
    t = A.ticks(spark, sf).select(
        "symbol", F.date_trunc("hour", "ts").alias("ts"), p.alias("open"), p.alias("high"), p.alias("low"),
        p.alias("close"), F.col("size").alias("volume"), F.col("seq").alias("arrival"),
    )
    return B.merge_tick_bars(t).select("symbol", F.unix_timestamp("ts").alias("ts_sec"), r6("close", "close"))


@query(
    "session_open_and_settlement",
    A.sql(
        """
    SELECT symbol, session_date::VARCHAR AS session_date,
           round(coalesce(arg_min(open, ts) FILTER (ts >= session_date::TIMESTAMP + INTERVAL 570 MINUTE),
                          arg_min(open, ts)), 6) AS open_price,
           round(CASE WHEN hour(max(ts)) * 60 + minute(max(ts)) >= 955 THEN arg_max(close, ts) END, 6)
             AS settlement_price
    FROM v_bars30 GROUP BY symbol, session_date""",
        "v_bars30",
    ),
)
def _(spark, sf):
    b = A.bars(spark, sf).withColumn(
        "session_open", F.col("session_date").cast("timestamp") + F.expr("INTERVAL 570 MINUTE")
    )
    opens = B.session_open_price(b)
    closes = B.session_settlement_price(b, tz=None)
    return opens.join(closes, ["symbol", "session_date"]).select(
        "symbol", F.col("session_date").cast("string").alias("session_date"),
        r6("open_price", "open_price"), r6("settlement_price", "settlement_price"),
    )


@query(
    "daily_settlement",
    A.sql(
        """
    SELECT symbol, ts::DATE::VARCHAR AS session_date, round(last(price ORDER BY ts, seq), 6) AS settlement_price
    FROM v_ticks GROUP BY symbol, ts::DATE""",
        "v_ticks",
    ),
)
def _(spark, sf):
    daily = A.bars(spark, sf, 1440)
    return B.daily_settlement(daily, tz=None).select(
        "symbol", F.col("session_date").cast("string").alias("session_date"), r6("settlement_price", "settlement_price")
    )


@query(
    "fullest_bar_path",
    A.sql(
        """
    SELECT session_date::VARCHAR AS session_date, len(list(close)) AS n_bars, round(sum(close), 4) AS sum_close,
           epoch(max(ts))::BIGINT AS as_of
    FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY symbol DESC) AS _x,
                 max(symbol) OVER (PARTITION BY session_date) AS last_symbol FROM v_bars60)
    WHERE symbol = last_symbol GROUP BY session_date""",
        "v_bars60",
    ),
)
def _(spark, sf):
    b = A.bars(spark, sf, 60)
    # one snapshot per (session, symbol): its bars so far; the last snapshot id of the session carries the path
    snaps = b.groupBy("session_date", F.col("symbol").alias("snapshot_id")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "close"))).alias("bars"),
    ).withColumn("ts", F.col("session_date").cast("timestamp"))
    return B.fullest_bar_path(snaps).select(
        F.col("session_date").cast("string").alias("session_date"),
        F.size("bars").alias("n_bars"),
        F.round(F.aggregate("bars", F.lit(0.0), lambda a, x: a + x["close"]), 4).alias("sum_close"),
        F.unix_timestamp(F.element_at("bars", -1)["ts"]).alias("as_of"),
    )


# -- indicators: the oracle recomputes recursions over the full history with list folds -------------------------
def rma(lst: str, p: int) -> str:
    return (
        f"CASE WHEN len({lst}) >= {p} THEN list_reduce(list_concat([list_avg({lst}[1:{p}])], {lst}[{p + 1}:]), "
        f"lambda a, x: (a * {p - 1} + x) / {p}) END"
    )


STEPS = """
WITH steps AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr_any,
         high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, close - lag(close) OVER w AS mv,
         ln(close / lag(close) OVER w) AS ret
  FROM v_bars30 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT *, i + 1 AS n, CASE WHEN i >= 1 THEN tr_any END AS tr,
         CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm,
         CASE WHEN mv > 0 THEN mv ELSE 0 END AS gain, CASE WHEN mv < 0 THEN -mv ELSE 0 END AS loss,
         CASE WHEN high > low THEN (2.0 * (close - low) / (high - low) - 1) * volume ELSE 0 END AS sv FROM steps)
"""
ID = "symbol, epoch(ts)::BIGINT AS ts_sec"
HIST = "OVER (PARTITION BY symbol ORDER BY ts)"


def rows(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + end} PRECEDING AND {last})"


def rank_sql(x: str) -> str:
    """Share of the last 100 known values strictly below the current one."""
    return (
        f"CASE WHEN len({x}) >= 2 THEN len(list_filter({x}, lambda v: v < {x}[-1])) / len({x})::DOUBLE END"
    )


@query(
    "true_range_atr",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(tr) FILTER (tr IS NOT NULL) {HIST} AS l FROM s)
    SELECT {ID}, round(tr, 6) AS true_range, round({rma('l', 14)}, 6) AS atr FROM h""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.true_range_atr(A.bars(spark, sf)), "true_range", "atr")


@query(
    "wilder_rma",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(close) {HIST} AS l FROM s)
    SELECT {ID}, round({rma('l', 14)}, 6) AS rma14 FROM h""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(R.wilder_rma(A.bars(spark, sf), "close", 14), "rma14")


@query(
    "ema_series",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(close) {HIST} AS l FROM s)
    SELECT {ID}, round(list_reduce(l, lambda a, x: x * (2.0 / 21) + a * (1 - 2.0 / 21)), 6) AS ema20 FROM h""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.ema_series(A.bars(spark, sf)), "ema20")


@query(
    "adx_di",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(tr) FILTER (i >= 1) {HIST} AS lt, list(pdm) FILTER (i >= 1) {HIST} AS lp,
                 list(mdm) FILTER (i >= 1) {HIST} AS lm FROM s),
    d AS (SELECT *, 100 * ({rma('lp', 14)}) / nullif({rma('lt', 14)}, 0) AS pdi,
                 100 * ({rma('lm', 14)}) / nullif({rma('lt', 14)}, 0) AS mdi FROM h),
    x AS (SELECT *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM d),
    z AS (SELECT *, list(dx) FILTER (i >= 1) {HIST} AS ld FROM x)
    SELECT {ID}, round(CASE WHEN n >= 28 THEN {rma('ld', 14)} END, 5) AS adx,
           round(CASE WHEN n >= 28 THEN pdi END, 5) AS plus_di, round(CASE WHEN n >= 28 THEN mdi END, 5) AS minus_di,
           round(CASE WHEN n >= 28 THEN pdi - mdi END, 5) AS di_spread FROM z""",
        "v_bars30",
    ),
)
def _(spark, sf):
    df = I.adx(A.bars(spark, sf))
    return df.select(
        "symbol", F.unix_timestamp("ts").alias("ts_sec"),
        *[F.round(f, 5).alias(f) for f in ("adx", "plus_di", "minus_di", "di_spread")],
    )


@query(
    "rsi",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(gain) FILTER (i >= 1) {HIST} AS lg, list(loss) FILTER (i >= 1) {HIST} AS ll
                 FROM s),
    r AS (SELECT *, {rma('lg', 14)} AS g, {rma('ll', 14)} AS l FROM h)
    SELECT {ID}, round(CASE WHEN n >= 15 THEN CASE WHEN l <= 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END
                       ELSE 100.0 - 100.0 / (1 + g / l) END END, 6) AS rsi FROM r""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.rsi(A.bars(spark, sf)), "rsi")


@query(
    "ema_slope",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(close) {HIST} AS l FROM s),
    e AS (SELECT *, list_reduce(l, lambda a, x: x * (2.0 / 21) + a * (1 - 2.0 / 21)) AS em FROM h),
    b AS (SELECT *, lag(em, 5) {HIST} AS back FROM e)
    SELECT {ID}, round(CASE WHEN n >= 25 THEN (em - back) / back * 100.0 / 5 END, 6) AS ema_slope FROM b""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.ema_slope(A.bars(spark, sf)), "ema_slope")


WIDTHS = STEPS + f""", b AS (SELECT *, CASE WHEN n >= 20 THEN avg(close) {rows(20)} END AS mid,
                 CASE WHEN n >= 20 THEN stddev_pop(close) {rows(20)} END AS sd FROM s),
    w AS (SELECT *, 4 * sd / mid AS bw FROM b)"""


@query(
    "bb_compression",
    A.sql(
        WIDTHS + f""", m AS (SELECT *, median(bw) {rows(20)} AS med FROM w)
    SELECT {ID}, round(CASE WHEN n >= 40 AND med > 0 THEN bw / med END, 6) AS bb_compression FROM m""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.bb_compression(A.bars(spark, sf)), "bb_compression")


@query(
    "trend_r_squared",
    A.sql(
        STEPS + f""", r AS (SELECT *, regr_r2(close, i) {rows(20)} AS r2, stddev_pop(close) {rows(20)} AS sd FROM s)
    SELECT {ID}, round(CASE WHEN n >= 20 AND sd > 0 THEN r2 END, 6) AS trend_cleanliness FROM r""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.trend_r_squared(A.bars(spark, sf)), "trend_cleanliness")


RV = STEPS + f""", v AS (SELECT *, CASE WHEN n >= 21 THEN stddev_pop(ret) {rows(20)} END AS rv20,
                 CASE WHEN n >= 6 THEN stddev_pop(ret) {rows(5)} END AS rv5 FROM s)"""


@query(
    "realized_vol_rank",
    A.sql(
        RV + f""", l AS (SELECT *, list(rv20) FILTER (rv20 IS NOT NULL) {rows(100)} AS h FROM v)
    SELECT {ID}, round(CASE WHEN n >= 22 THEN {rank_sql('h')} END, 6) AS realized_vol FROM l""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.realized_vol_rank(A.bars(spark, sf)), "realized_vol")


@query(
    "rv_expansion",
    A.sql(
        RV + f"""
    SELECT {ID}, round(CASE WHEN n >= 22 AND rv20 > 0 THEN rv5 / rv20 - 1 END, 6) AS rv_expansion FROM v""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.rv_expansion(A.bars(spark, sf)), "rv_expansion")


@query(
    "rolling_vwap",
    A.sql(
        STEPS + f""", v AS (SELECT *, sum(close * volume) {rows(20)} / nullif(sum(volume) {rows(20)}, 0) AS vw,
                 sum(close * volume) {rows(19, 1)} / nullif(sum(volume) {rows(19, 1)}, 0) AS pv FROM s)
    SELECT {ID}, round(CASE WHEN n >= 2 THEN (close - vw) / close * 100 END, 6) AS dist_to_vwap,
           round(CASE WHEN n >= 2 THEN coalesce((vw - pv) / pv * 100, 0) END, 6) AS vwap_slope FROM v""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.rolling_vwap(A.bars(spark, sf)), "dist_to_vwap", "vwap_slope")


@query(
    "range_position",
    A.sql(
        STEPS + f""", r AS (SELECT *, max(high) {rows(20)} AS hi, min(low) {rows(20)} AS lo FROM s)
    SELECT {ID}, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END, 6) AS range_position FROM r""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.range_position(A.bars(spark, sf)), "range_position")


@query("signed_volume_proxy", A.sql(STEPS + f"SELECT {ID}, round(sv, 6) AS signed_volume FROM s", "v_bars30"))
def _(spark, sf):
    return keyed(I.signed_volume(A.bars(spark, sf)), "signed_volume")


@query(
    "cvd_slope",
    A.sql(
        STEPS + f""", c AS (SELECT *, sum(sv) {HIST} AS cvd, avg(volume) {rows(5)} AS av FROM s),
    b AS (SELECT *, lag(cvd, 5) {HIST} AS back FROM c)
    SELECT {ID}, round(CASE WHEN n >= 6 THEN (cvd - back) / (CASE WHEN av > 0 THEN av ELSE 1 END * 5) END, 6)
             AS cvd_persistence FROM b""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.cvd_slope(A.bars(spark, sf)), "cvd_persistence")


@query(
    "bollinger",
    A.sql(
        WIDTHS + f""", l AS (SELECT *, list(bw) FILTER (bw IS NOT NULL) {rows(100)} AS h, lag(bw, 5) {HIST} AS back
                 FROM w)
    SELECT {ID}, round(CASE WHEN n >= 20 THEN {rank_sql('h')} END, 6) AS bb_width,
           round(CASE WHEN sd > 0 THEN (close - (mid - 2 * sd)) / (4 * sd) END, 6) AS bb_position,
           round(CASE WHEN n >= 25 AND back > 0 THEN bw / back - 1 END, 6) AS bb_expansion FROM l""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(I.bollinger(A.bars(spark, sf)), "bb_width", "bb_position", "bb_expansion")


@query(
    "keltner",
    A.sql(
        WIDTHS + f""", h AS (SELECT *, list(tr) FILTER (i >= 1) {HIST} AS lt, list(close) {HIST} AS lc FROM w),
    k AS (SELECT *, {rma('lt', 20)} AS a, list_reduce(lc, lambda a, x: x * (2.0 / 21) + a * (1 - 2.0 / 21)) AS e FROM h),
    p AS (SELECT *, 3.0 * a / e AS kw, (close - (e - 1.5 * a)) / nullif(3.0 * a, 0) AS kp FROM k),
    l AS (SELECT *, list(kw) FILTER (kw IS NOT NULL) {rows(100)} AS hk, avg(kp - 0.5) {rows(10)} AS tr10 FROM p)
    SELECT {ID}, round(CASE WHEN a > 0 THEN {rank_sql('hk')} END, 6) AS keltner_width,
           round(CASE WHEN a > 0 THEN kp END, 6) AS keltner_position,
           round(CASE WHEN a > 0 THEN tr10 END, 6) AS keltner_trend_strength,
           round(CASE WHEN a > 0 AND bw IS NOT NULL THEN greatest(0, least(1, (1 - bw / kw) / 0.4)) END, 6)
             AS bb_squeeze FROM l""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(
        I.keltner(A.bars(spark, sf)), "keltner_width", "keltner_position", "keltner_trend_strength", "bb_squeeze"
    )


@query(
    "donchian",
    A.sql(
        STEPS + f""", h AS (SELECT *, list(tr) FILTER (i >= 1) {HIST} AS lt, max(high) {rows(20)} AS hi,
                 min(low) {rows(20)} AS lo, max(high) {rows(20, 1)} AS ph, min(low) {rows(20, 1)} AS pl FROM s),
    k AS (SELECT *, {rma('lt', 20)} AS a, CASE WHEN n >= 20 THEN (hi - lo) / close END AS dw FROM h),
    l AS (SELECT *, list(dw) FILTER (dw IS NOT NULL) {rows(100)} AS hd FROM k)
    SELECT {ID}, round(CASE WHEN n >= 21 AND hi > lo THEN {rank_sql('hd')} END, 6) AS donchian_width,
           round(CASE WHEN n >= 21 AND hi > lo THEN (close - lo) / (hi - lo) END, 6) AS donchian_position,
           round(CASE WHEN n >= 21 AND a > 0 THEN greatest(0, (close - ph) / a) END, 6) AS donchian_breakout_up,
           round(CASE WHEN n >= 21 AND a > 0 THEN greatest(0, (pl - close) / a) END, 6) AS donchian_breakout_down
    FROM l""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(
        I.donchian(A.bars(spark, sf)),
        "donchian_width", "donchian_position", "donchian_breakout_up", "donchian_breakout_down",
    )


@query("mtf_matrix")
def _(spark, sf):
    m = I.mtf_matrix(A.bars(spark, sf, 1), tz=None)
    return keyed(m, *I.FIELDS, keys=("symbol", "timeframe")).withColumn("n_fields", F.lit(len(I.FIELDS)))


@query("mtf_feature_map")
def _(spark, sf):
    m = I.mtf_matrix(A.bars(spark, sf, 1), (30, 60, 240), tz=None)
    return I.mtf_feature_map(m, ["symbol", "ts"]).select(
        "symbol", F.unix_timestamp("ts").alias("ts_sec"), "name", r6("value", "value")
    )


@query(
    "percentile_rank",
    A.sql(
        f"""
    SELECT symbol, epoch(ts)::BIGINT AS ts_sec, round({rank_sql('h')}, 6) AS close_rank
    FROM (SELECT *, list(close) {rows(100)} AS h FROM v_bars30)""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return keyed(R.percentile_rank(A.bars(spark, sf), "close"), "close_rank")


@query(
    "robust_zscore",
    A.sql(
        f"""
    SELECT symbol, epoch(ts)::BIGINT AS ts_sec,
           round(CASE WHEN len(h) >= 20 THEN CASE WHEN mad > 0 THEN (close - med) / (1.4826 * mad) ELSE 0 END END, 5)
             AS robust_z
    FROM (SELECT *, list_median(list_transform(h, lambda v: abs(v - med))) AS mad
          FROM (SELECT *, list_median(h) AS med
                FROM (SELECT *, list(close) {rows(500, 1)} AS h FROM v_bars30)))""",
        "v_bars30",
    ),
)
def _(spark, sf):
    return R.robust_zscore(A.bars(spark, sf), "close").select(
        "symbol", F.unix_timestamp("ts").alias("ts_sec"), F.round("robust_z", 5).alias("robust_z")
    )


@query(
    "gex_rank",
    A.sql(
        """
    SELECT symbol, epoch(ts)::BIGINT AS ts_sec, n,
           round(CASE WHEN n < 30 THEN 0.5 ELSE below / n::DOUBLE END, 6) AS pct_rank
    FROM (SELECT a.symbol, a.ts, count(*) AS n,
                 count(*) FILTER (abs(b.close - 104) < abs(a.close - 104)) AS below
          FROM v_bars30 a JOIN v_bars30 b ON a.symbol = b.symbol AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 10 DAY
          GROUP BY ALL)""",
        "v_bars30",
    ),
)
def _(spark, sf):
    b = A.bars(spark, sf).withColumn("net_gex", F.col("close") - 104)
    return R.gex_rank(b, "net_gex").select(
        "symbol", F.unix_timestamp("ts").alias("ts_sec"), F.col("n").cast("long").alias("n"), r6("pct_rank", "pct_rank")
    )
