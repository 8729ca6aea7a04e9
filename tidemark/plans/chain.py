"""Queries: option-chain analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.functions.tables import bucketed
from tidemark.operators import chain as C
from tidemark.operators import features as X
from tidemark.plans import adapters as A
from tidemark.plans.registry import query

MID_SQL = "coalesce(CASE WHEN ask >= bid AND bid >= 0 THEN (bid + ask) / 2 END, mark, last)"


@query(
    "quote_mid",
    A.sql(f"SELECT snapshot_id, side, strike, round({MID_SQL}, 9) AS mid, round(coalesce(mark, (bid + ask) / 2), 9) AS pricing_mid FROM v_chain", "v_chain"),
)
def _(spark, sf):
    return A.chain(spark, sf).select(
        "snapshot_id", "side", "strike", F.round(C.quote_mid(), 9).alias("mid"), F.round(C.quote_mid_mark_first(), 9).alias("pricing_mid")
    )


@query(
    "quote_quality",
    A.sql("SELECT snapshot_id, side, strike, round(CASE WHEN ask >= bid THEN 1 / (1 + (ask - bid)) ELSE 0 END, 6) AS quality FROM v_chain", "v_chain"),
)
def _(spark, sf):
    return A.chain(spark, sf).select("snapshot_id", "side", "strike", r6(C.quote_quality(), "quality"))


@query(
    "chain_coverage",
    A.sql(
        """SELECT snapshot_id, count(*) AS contracts_total, count(DISTINCT strike) AS strikes_total, min(strike) AS min_strike,
           max(strike) AS max_strike, bool_or(side = 'call')::INT AS has_calls, bool_or(side = 'put')::INT AS has_puts
           FROM v_quotes GROUP BY 1""",
        "v_quotes",
    ),
)
def _(spark, sf):
    return C.chain_coverage(A.quotes(spark, sf)).select(
        "snapshot_id", "contracts_total", "strikes_total", "min_strike", "max_strike",
        F.col("has_calls").cast("int").alias("has_calls"), F.col("has_puts").cast("int").alias("has_puts"),
    )


GEX = """WITH g AS (SELECT *, gamma * open_interest * 100 * spot * spot * 0.01 AS d FROM v_quotes WHERE open_interest > 0),
  s AS (SELECT snapshot_id, strike, spot, sum(CASE side WHEN 'call' THEN d ELSE -d END) AS gex,
          sum(abs(d)) FILTER (side = 'call') AS cg, sum(abs(d)) FILTER (side = 'put') AS pg,
          min(pos) FILTER (side = 'call') AS cp, min(pos) FILTER (side = 'put') AS pp, count(*) AS n
        FROM g GROUP BY ALL)"""


@query("gex_by_strike", A.sql(GEX + " SELECT snapshot_id, strike, round(gex, 2) AS gex, n AS n_contracts FROM s", "v_quotes"))
def _(spark, sf):
    return C.gex_by_strike(A.quotes(spark, sf)).select(
        "snapshot_id", "strike", F.round("gex", 2).alias("gex"), "n_contracts"
    )


@query(
    "gex_levels",
    A.sql(
        GEX + """ SELECT snapshot_id, round(sum(gex) / 1e9, 6) AS net_gex_bn, round(sum(gex) / sum(abs(gex)), 6) AS net_ratio,
          round(max(abs(gex)) / sum(abs(gex)), 6) AS gex_concentration,
          round(greatest(coalesce(first(cg ORDER BY (strike >= spot) DESC, cg DESC, cp) FILTER (cp IS NOT NULL) / sum(cg), 0),
                         coalesce(first(pg ORDER BY (strike <= spot) DESC, pg DESC, pp) FILTER (pp IS NOT NULL) / sum(pg), 0)), 6) AS wall_concentration,
          sum(n)::BIGINT AS n_contracts, count(*) AS n_strikes FROM s GROUP BY 1""",
        "v_quotes",
    ),
)
def _(spark, sf):
    return C.gex_levels(A.quotes(spark, sf)).select(
        "snapshot_id", r6("net_gex_bn", "net_gex_bn"), r6("net_ratio", "net_ratio"),
        r6("gex_concentration", "gex_concentration"), r6("wall_concentration", "wall_concentration"),
        "n_contracts", "n_strikes",
    )


@query(
    "call_put_walls",
    A.sql(
        GEX + """ SELECT snapshot_id,
          coalesce(first(strike ORDER BY (strike >= spot) DESC, cg DESC, cp) FILTER (cp IS NOT NULL), max(spot)) AS call_wall,
          coalesce(first(strike ORDER BY (strike <= spot) DESC, pg DESC, pp) FILTER (pp IS NOT NULL), max(spot)) AS put_wall
        FROM s GROUP BY 1""",
        "v_quotes",
    ),
)
def _(spark, sf):
    return C.gex_levels(A.quotes(spark, sf)).select("snapshot_id", "call_wall", "put_wall")


@query(
    "gamma_flip",
    A.sql(
        GEX + """, c AS (SELECT *, sum(gex) OVER (PARTITION BY snapshot_id ORDER BY strike) AS cum FROM s),
        p AS (SELECT *, lag(cum) OVER w AS pc, lag(strike) OVER w AS pk FROM c WINDOW w AS (PARTITION BY snapshot_id ORDER BY strike))
        SELECT snapshot_id, round(coalesce(arg_min(pk + (strike - pk) * (0 - pc) / (cum - pc), strike)
                 FILTER ((pc < 0 AND cum >= 0) OR (pc > 0 AND cum <= 0)), max(spot)), 4) AS gamma_flip
        FROM p GROUP BY 1""",
        "v_quotes",
    ),
)
def _(spark, sf):
    return C.gex_levels(A.quotes(spark, sf)).select("snapshot_id", "gamma_flip")


@query(
    "flow",
    A.sql(
        """SELECT snapshot_id, cv AS call_volume, pv AS put_volume, oi AS total_open_interest, round(pv / nullif(cv, 0), 6) AS pcr_volume,
             round(CASE WHEN cv + pv > 0 THEN (cv + pv) / nullif(oi, 0) END, 9) AS volume_oi_ratio
           FROM (SELECT snapshot_id, coalesce(sum(volume) FILTER (side = 'call'), 0)::BIGINT AS cv,
                        coalesce(sum(volume) FILTER (side = 'put'), 0)::BIGINT AS pv, sum(open_interest)::BIGINT AS oi FROM v_quotes GROUP BY 1)""",
        "v_quotes",
    ),
)
def _(spark, sf):
    return C.flow(A.quotes(spark, sf)).select(
        "snapshot_id", "call_volume", "put_volume", "total_open_interest", r6("pcr_volume", "pcr_volume"),
        F.round("volume_oi_ratio", 9).alias("volume_oi_ratio"),
    )


STRADDLE_SQL = f"""WITH m AS (SELECT *, {MID_SQL} AS mid FROM v_chain),
  k AS (SELECT snapshot_id, first(strike ORDER BY abs(strike - spot), strike) AS atm FROM m GROUP BY 1),
  a AS (SELECT snapshot_id, max(atm) AS atm_strike, max(spot) AS spot, arg_min(mid, pos) FILTER (side = 'call') + arg_min(mid, pos) FILTER (side = 'put') AS st
        FROM m JOIN k USING (snapshot_id) WHERE strike = atm GROUP BY 1)"""


@query(
    "atm_straddle",
    A.sql(
        STRADDLE_SQL + """ SELECT snapshot_id, atm_strike, round(st, 6) AS atm_straddle, round(st / spot, 6) AS expected_move_pct,
        round(abs(spot - 20) / st, 6) AS expected_move_consumed FROM a WHERE st IS NOT NULL""",
        "v_chain",
    ),
)
def _(spark, sf):
    ch = A.chain(spark, sf)
    opens = ch.select("snapshot_id").distinct().withColumn("open_price", F.lit(20.0))
    return C.atm_straddle(ch, opens).select(
        "snapshot_id", "atm_strike", r6("atm_straddle", "atm_straddle"), r6("expected_move_pct", "expected_move_pct"),
        r6("expected_move_consumed", "expected_move_consumed"),
    )


@query(
    "spot_from_parity",
    A.sql(
        """WITH m AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) AS sp FROM v_chain),
      t AS (SELECT snapshot_id, strike, arg_min(mid, (sp, pos)) FILTER (side = 'call') AS c, arg_min(mid, (sp, pos)) FILTER (side = 'put') AS p
            FROM m GROUP BY ALL),
      d AS (SELECT * , c - p + strike AS est, row_number() OVER (PARTITION BY snapshot_id ORDER BY abs(c - p), strike) AS r FROM t WHERE c IS NOT NULL AND p IS NOT NULL),
      n AS (SELECT d.*, row_number() OVER (PARTITION BY snapshot_id ORDER BY abs(d.strike - z.k), d.strike) AS q
            FROM d JOIN (SELECT snapshot_id, strike AS k FROM d WHERE r = 1) z USING (snapshot_id)),
      e AS (SELECT snapshot_id, max(q) AS n_paired, list_sort(list(est) FILTER (q <= 5)) AS es FROM n GROUP BY 1),
      s AS (SELECT snapshot_id, arg_min(strike, (abs(delta - 0.5), pos, strike)) FILTER (side = 'call' AND delta > 0) AS dk FROM v_chain GROUP BY 1)
      SELECT snapshot_id, coalesce(n_paired, 0)::INT AS n_paired, round(CASE WHEN n_paired > 0 THEN CASE WHEN es[len(es) // 2 + 1] > 0 THEN es[len(es) // 2 + 1] END
             WHEN dk > 0 THEN dk END, 2) AS implied_spot FROM s LEFT JOIN e USING (snapshot_id)""",
        "v_chain",
    ),
)
def _(spark, sf):
    return C.spot_from_parity(A.chain(spark, sf))


@query(
    "rnd_summary",
    A.sql(
        f"""WITH m AS (SELECT snapshot_id, spot, strike AS k, {MID_SQL} AS c FROM v_chain WHERE side = 'call'),
      n AS (SELECT *, lead(k) OVER w AS k2, lead(c) OVER w AS c2, min(k) OVER (PARTITION BY snapshot_id) AS k0,
                   max(k) OVER (PARTITION BY snapshot_id) AS kn, count(*) OVER (PARTITION BY snapshot_id) AS ns
            FROM m WINDOW w AS (PARTITION BY snapshot_id ORDER BY k)),
      g AS (SELECT DISTINCT snapshot_id, spot, k0, kn, ns, j, CASE WHEN j = 200 THEN kn ELSE k0 + j * ((kn - k0) / 200) END AS x, (kn - k0) / 200 AS h
            FROM n, (SELECT unnest(range(201)) AS j) WHERE ns >= 5),
      f AS (SELECT g.*, n.c + (n.c2 - n.c) * (g.x - n.k) / (n.k2 - n.k) AS f FROM g JOIN n ON g.snapshot_id = n.snapshot_id AND n.k2 IS NOT NULL
            AND g.x >= n.k AND (g.x < n.k2 OR (n.k2 = n.kn AND g.j = 200))),
      a AS (SELECT *, CASE WHEN j = 0 THEN (lead(f) OVER w - f) / h WHEN j = 200 THEN (f - lag(f) OVER w) / h ELSE (lead(f) OVER w - lag(f) OVER w) / (2 * h) END AS g1
            FROM f WINDOW w AS (PARTITION BY snapshot_id ORDER BY j)),
      b AS (SELECT *, greatest(0, CASE WHEN j = 0 THEN (lead(g1) OVER w - g1) / h WHEN j = 200 THEN (g1 - lag(g1) OVER w) / h
                   ELSE (lead(g1) OVER w - lag(g1) OVER w) / (2 * h) END) AS d FROM a WINDOW w AS (PARTITION BY snapshot_id ORDER BY j)),
      t AS (SELECT *, lead(d) OVER w AS d2, lead(x) OVER w AS x2 FROM b WINDOW w AS (PARTITION BY snapshot_id ORDER BY j)),
      z AS (SELECT snapshot_id, sum((d + d2) / 2 * h) AS area, sum((x * d + x2 * d2) / 2 * h) / sum((d + d2) / 2 * h) AS mu FROM t WHERE d2 IS NOT NULL GROUP BY 1),
      v AS (SELECT t.snapshot_id, max(ns) AS n_strikes, max(mu) AS mean, sqrt(sum(((x - mu) ** 2 * d + (x2 - mu) ** 2 * d2) / 2 * h / area)) AS sd,
                   sum(((x - mu) ** 3 * d + (x2 - mu) ** 3 * d2) / 2 * h / area) AS m3,
                   coalesce(sum((d + d2) / 2 * h / area) FILTER (x2 < spot), 0) AS pb
            FROM t JOIN z USING (snapshot_id) WHERE d2 IS NOT NULL AND area > 0 GROUP BY 1)
      SELECT snapshot_id, n_strikes, round(mean, 5) AS mean, round(sd, 5) AS std, round(m3 / sd ** 3, 5) AS skew, round(pb, 5) AS prob_below_spot FROM v""",
        "v_chain",
    ),
)
def _(spark, sf):
    r = C.rnd_summary(A.chain(spark, sf, ("bid", "ask", "mark", "last")))
    return r.select("snapshot_id", "n_strikes", *[F.round(n, 5).alias(n) for n in ("mean", "std", "skew", "prob_below_spot")])


BREADTH_SYMBOLS = ("SPY", "RSP", *C.SECTORS, *C.TOP10_WEIGHTS)


@query(
    "breadth",
    "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {w})" for s, w in C.TOP10_WEIGHTS.items()) + ") t(symbol, w)), "
    "e AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, list_value(" + ", ".join(f"'{s}'" for s in BREADTH_SYMBOLS) + ")[1 + user_id % 23] AS symbol, "
    """value / 100 - 0.5 AS move, event_id AS seq FROM events),
    l AS (SELECT snapshot_id, symbol, arg_max(move, seq) AS move FROM e GROUP BY ALL)
    SELECT snapshot_id, round(max(move) FILTER (symbol = 'RSP') - max(move) FILTER (symbol = 'SPY'), 6) AS rsp_spy_div,
      round(count(*) FILTER (symbol LIKE 'XL%' AND move > 0) / nullif(count(*) FILTER (symbol LIKE 'XL%'), 0)::DOUBLE, 6) AS sector_align,
      round(sum(w * move) / sum(w), 6) AS top10_pressure, count(*) FILTER (symbol LIKE 'XL%') AS sectors_observed
    FROM l LEFT JOIN w USING (symbol) GROUP BY 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"),
        F.element_at(F.array(*[F.lit(s) for s in BREADTH_SYMBOLS]), (F.col("user_id") % 23 + 1).cast("int")).alias("symbol"),
        (F.col("value") / 100 - 0.5).alias("move"),
        F.col("event_id").alias("seq"),
    )
    return C.breadth(e, C.TOP10_WEIGHTS).select(
        "snapshot_id", r6("rsp_spy_div", "rsp_spy_div"), r6("sector_align", "sector_align"),
        r6("top10_pressure", "top10_pressure"), "sectors_observed",
    )


@query(
    "vix_term_structure",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d %H') AS snapshot_id, ['VIX', 'VIX9D', 'VIX3M', 'VVIX'][1 + user_id % 4] AS symbol, value - 5 AS last, event_id AS seq
                 FROM events WHERE value - 5 > 0),
      p AS (SELECT snapshot_id, arg_max(last, seq) FILTER (symbol = 'VIX') AS vix, arg_max(last, seq) FILTER (symbol = 'VIX9D') AS vix9d,
                   arg_max(last, seq) FILTER (symbol = 'VIX3M') AS vix3m, arg_max(last, seq) FILTER (symbol = 'VVIX') AS vvix FROM e GROUP BY 1)
      SELECT snapshot_id, round(vix, 6) AS vix, round(vix3m / vix - 1, 6) AS contango, round(vix9d / vix - 1, 6) AS near_term_stress,
             round(vvix / 90 - 1, 6) AS vvix_elevation FROM p WHERE vix IS NOT NULL""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("snapshot_id"),
        F.element_at(F.array(*[F.lit(s) for s in C.VOL_INDICES]), (F.col("user_id") % 4 + 1).cast("int")).alias("symbol"),
        (F.col("value") - 5).alias("last"),
        F.lit(90.0).alias("vvix_baseline"),
        F.col("event_id").alias("seq"),
    )
    return C.vix_term_structure(e).select(
        "snapshot_id", *[r6(n, n) for n in ("vix", "contango", "near_term_stress", "vvix_elevation")]
    )


@query(
    "live_quote_fraction",
    "SELECT strftime(l_shipdate, '%Y-%m') AS snapshot_id, round(avg((l_returnflag <> 'N')::INT), 6) AS live_fraction FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot_id"),
        F.array(F.lit("imported"), F.when(F.col("l_returnflag") != "N", "live_quote")).alias("quality_flags"),
    ).withColumn("quality_flags", F.array_compact("quality_flags"))
    return C.live_quote_fraction(li).select("snapshot_id", r6("live_fraction", "live_fraction"))


@query(
    "structural_state",
    A.sql(
        STRADDLE_SQL + """, c AS (SELECT snapshot_id, count(*) FILTER (side = 'call' AND mid IS NOT NULL) AS n FROM m GROUP BY 1)
      SELECT i.snapshot_id, concat_ws(',', CASE WHEN st IS NULL THEN 'volatility' END, CASE WHEN c.n < 5 THEN 'rnd' END) AS missing,
             round(st, 6) AS atm_straddle, n_strikes
      FROM (SELECT snapshot_id, count(DISTINCT strike) AS n_strikes FROM v_chain WHERE open_interest > 0 GROUP BY 1) i
           LEFT JOIN a USING (snapshot_id) LEFT JOIN c USING (snapshot_id)""",
        "v_chain",
    ),
)
def _(spark, sf):
    ch = A.chain(spark, sf, ("gamma", "open_interest", "bid", "ask", "mark", "last"), together=True)
    ids = ch.groupBy("snapshot_id").count()
    st = C.structural_state(C.gex_levels(ch), C.atm_straddle(ch), C.rnd_summary(ch), ids)
    return st.select(
        "snapshot_id", F.array_join("missing_fields", ",").alias("missing"),
        r6("volatility.atm_straddle", "atm_straddle"), F.col("gex_oi.n_strikes").alias("n_strikes"),
    )


def bundle_inputs(spark, sf):
    """lineitem as all that a snapshot carries: facts, chain, minute bars, sector moves and volatility indices.

    Returned lines have no index print and accepted ones no move, so families are missing here and there; one line in 997
    has a move of infinite size, so breadth fails in the snapshots where such a move counts. Lines move once, by snapshot; all
    that is returned lies by snapshot_id.
    """
    read = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    lines = bucketed(A.table(spark, sf, "lineitem").select(A.block_month().alias("snapshot_id"), *read), "snapshot_id", "bundle_lines")
    li = lines.withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    day = F.to_timestamp(F.concat(F.substring("snapshot_id", 1, 7), F.lit("-15 14:30:00")))
    pick = lambda names, key: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % len(names) + 1).cast("int"))
    facts = li.groupBy("snapshot_id").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n"))
    m = F.col("m")
    snapshots = facts.select(
        "snapshot_id", F.timestamp_seconds(F.unix_timestamp(day) + (m % 400) * 60).alias("ts"), F.lit(25.0).alias("spot"),
        F.when(m % 5 != 0, m % 400).alias("minutes_from_open"), F.when(m % 5 != 0, 390 - m % 400).alias("minutes_to_close"),
        (m % 3 / 4).alias("penalty"), (m % 3 == 0).alias("is_live"), F.when(m % 4 != 0, 24.0).alias("underlying_bid"), F.lit(25.0).alias("underlying_ask"),
    )
    q = F.col("l_quantity").cast("double")
    bars = li.groupBy("snapshot_id", F.timestamp_seconds(F.unix_timestamp(day) + (F.col("l_partkey") % 420 - 20) * 60).alias("ts")).agg(
        F.min_by(q, "seq").alias("open"), F.max(q + 1).alias("high"), F.min(q - 1).alias("low"), F.max_by(q, "seq").alias("close"), F.count(F.lit(1)).alias("volume")
    )
    moves = li.filter("l_returnflag <> 'A'").select(
        "snapshot_id", pick(BREADTH_SYMBOLS, "l_partkey").alias("symbol"), "seq",
        F.when((F.col("seq") % 997 == 0), float("inf")).otherwise(F.col("l_discount") - 0.05).alias("move"),
    )
    indices = li.filter("l_returnflag <> 'R'").select("snapshot_id", pick(C.VOL_INDICES, "l_suppkey").alias("symbol"), (q - 5).alias("last"), F.lit(90.0).alias("vvix_baseline"), "seq")
    return snapshots, A.chain(spark, sf, lines=lines), bars, moves, indices


@query("feature_bundle")
def _(spark, sf):
    inputs = bundle_inputs(spark, sf)
    b = C.feature_bundle(X.family_rows(*inputs, tz=None, placed=True), inputs[0])
    return b.select(
        "snapshot_id", "n_features", F.array_join("missing_families", ",").alias("missing"), F.array_join("failed_families", ",").alias("failed"), "bundle_id",
        r6(F.col("features")["gex.net_ratio"], "net_ratio"), r6(F.col("features")["1m.last_return"], "last_return"),
    )


@query(
    "feature_families",
    A.sql(
        """WITH li AS (SELECT *, """ + A.BLOCK_MONTH_SQL + """ AS snapshot_id, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
    f AS (SELECT snapshot_id, max(seq) AS m FROM li GROUP BY 1),
    kc AS (SELECT snapshot_id, count(*) AS contracts, count(DISTINCT strike) AS strikes, sum(volume) FILTER (side = 'call') AS cv, sum(volume) FILTER (side = 'put') AS pv, sum(open_interest) AS oi FROM v_chain GROUP BY 1),
    b AS (SELECT snapshot_id, l_partkey % 420 - 20 AS t, arg_min(l_quantity, seq) AS open FROM li GROUP BY ALL),
    o AS (SELECT snapshot_id, coalesce(arg_min(open, t) FILTER (m % 5 <> 0 AND t >= 0), arg_min(open, t)) AS open FROM b JOIN f USING (snapshot_id) GROUP BY 1),
    """ + STRADDLE_SQL[len("WITH "):] + """,
    mv AS (SELECT snapshot_id, symbol, arg_max(move, seq) AS move FROM (SELECT snapshot_id, seq, list_value(""" + ", ".join(f"'{s}'" for s in BREADTH_SYMBOLS) + """)[1 + l_partkey % 23] AS symbol,
           CASE WHEN seq % 997 = 0 THEN 'inf'::DOUBLE ELSE l_discount - 0.05 END AS move FROM li WHERE l_returnflag <> 'A') GROUP BY ALL),
    br AS (SELECT snapshot_id, count(*) FILTER (symbol LIKE 'XL%') AS n, count(*) FILTER (symbol LIKE 'XL%' AND move > 0) AS up,
           bool_or(symbol = 'SPY') AND bool_or(symbol = 'RSP') AS pair, bool_or(symbol IN (""" + ", ".join(f"'{s}'" for s in C.TOP10_WEIGHTS) + """)) AS top,
           bool_or(isinf(move) AND symbol IN ('SPY', 'RSP')) AS inf_pair, bool_or(isinf(move) AND symbol NOT IN ('SPY', 'RSP') AND symbol NOT LIKE 'XL%') AS inf_top FROM mv GROUP BY 1),
    ix AS (SELECT snapshot_id, arg_max(l_quantity - 5, seq) AS vix FROM li WHERE l_returnflag <> 'R' AND l_suppkey % 4 = 0 AND l_quantity > 5 GROUP BY 1)
    SELECT snapshot_id, CASE WHEN m % 5 <> 0 THEN (m % 400)::DOUBLE END AS minutes_from_open, round((m % 3) / 4.0, 6) AS penalty, CASE WHEN m % 4 <> 0 THEN round(1 / 24.5, 6) END AS spread_pct,
      contracts::DOUBLE AS contracts, strikes::DOUBLE AS strikes, CASE WHEN cv + pv > 0 OR oi > 0 THEN coalesce(cv, 0)::DOUBLE END AS call_volume, CASE WHEN cv > 0 THEN round(coalesce(pv, 0) / cv::DOUBLE, 6) END AS pcr_volume,
      round(st, 6) AS straddle, CASE WHEN st > 0 THEN round(abs(25 - open) / st, 6) END AS consumed,
      coalesce((inf_pair AND pair) OR (inf_top AND top), FALSE) AS breadth_failed, round(CASE WHEN n > 0 AND NOT ((inf_pair AND pair) OR (inf_top AND top)) THEN up / n::DOUBLE END, 6) AS sector_align, vix
    FROM f LEFT JOIN kc USING (snapshot_id) LEFT JOIN o USING (snapshot_id) LEFT JOIN a USING (snapshot_id) LEFT JOIN br USING (snapshot_id) LEFT JOIN ix USING (snapshot_id)""",
        "v_chain",
    ),
)
def _(spark, sf):
    """The families that SQL can say, out of a bundle of those families."""
    inputs = bundle_inputs(spark, sf)
    rows = X.family_rows(*inputs, tz=None, placed=True)
    b = C.feature_bundle({n: rows[n] for n in ("vol", "flow", "breadth", "vix", "session")}, inputs[0])
    g = lambda name, alias: r6(F.col("features")[name], alias)
    return b.select(
        "snapshot_id", g("session.minutes_from_open", "minutes_from_open"), g("session.data_quality_penalty", "penalty"), g("session.underlying_spread_pct", "spread_pct"),
        g("session.contracts", "contracts"), g("session.strikes", "strikes"), g("flow.call_volume", "call_volume"), g("flow.pcr_volume", "pcr_volume"),
        g("vol.atm_straddle", "straddle"), g("vol.expected_move_consumed", "consumed"), F.array_contains("failed_families", "breadth").alias("breadth_failed"),
        g("breadth.sector_align", "sector_align"), g("vix.vix", "vix"),
    )
