"""Queries: fill economics, marks, exits, settlement, sizing and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import economics as E
from tidemark.operators import risk as K
from tidemark.operators import structures as S
from tidemark.plans import adapters as A
from tidemark.plans.registry import query
from tidemark.plans.structures import ENUM, LEGS, PROOF

FAMS = ("long_straddle", "call_debit_spread", "bear_call_credit_spread")
FAM_SQL = "('long_straddle', 'call_debit_spread', 'bear_call_credit_spread')"


def candidates(spark, sf):
    chain = A.options(spark, sf)
    cfg = S.StructureConfig(families=FAMS)
    return S.with_identity(S.prove_bounded_loss(S.enumerate_structures(chain, cfg)))


# legs with their two-sided quotes
QUOTED = ENUM + f""", lg AS (SELECT snapshot_id, family, {LEGS} AS legs, unnest(legs) AS g FROM x WHERE family IN {FAM_SQL}),
  q AS (SELECT lg.snapshot_id, family, legs, count(*) AS n, sum(-lg.g.q * o.mid) AS mid, sum(-lg.g.q * CASE WHEN lg.g.q > 0 THEN o.ask ELSE o.bid END) AS nat, max(o.age_seconds) AS age
        FROM lg JOIN v_options o ON o.snapshot_id = lg.snapshot_id AND o.option_type = lg.g.t AND o.strike = lg.g.k GROUP BY ALL)"""


PRICED = PROOF + QUOTED[len(ENUM):].replace("FROM x WHERE family", "FROM b WHERE (loss <> 0 OR credit <> 0) AND family")


@query(
    "net_mid_and_natural",
    A.sql(QUOTED + " SELECT snapshot_id, family, legs, round(mid::DOUBLE, 6) AS mid_price, round(nat::DOUBLE, 6) AS natural_price FROM q", "v_options"),
)
def _(spark, sf):
    c = S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=FAMS))
    mid, nat = E.net_prices()
    return c.select("snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"), r6(mid, "mid_price"), r6(nat, "natural_price"))


@query(
    "leg_quote_join",
    A.sql(
        PRICED + " SELECT snapshot_id, family, count(*) AS n, round(sum(mid)::DOUBLE, 4) AS sum_mid, round(sum(nat)::DOUBLE, 4) AS sum_natural FROM q GROUP BY ALL",
        "v_options",
    ),
)
def _(spark, sf):
    chain = A.options(spark, sf)
    c = candidates(spark, sf)
    ids = c.select(
        "snapshot_id", "family", "candidate_id",
        F.transform("legs", lambda x: F.struct(x["q"]["contract_id"].alias("contract_id"), x["quantity"].alias("quantity"))).alias("legs"),
    )
    priced = E.leg_prices(ids, chain)
    return ids.join(priced, ["snapshot_id", "candidate_id"]).groupBy("snapshot_id", "family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("mid_price").cast("double"), 4).alias("sum_mid"),
        F.round(F.sum("natural_price").cast("double"), 4).alias("sum_natural"),
    )


ECON = PRICED + """, ec AS (SELECT *, greatest(mid - nat, 0) AS half, greatest(mid - nat, 0) / CASE WHEN mid = 0 THEN 1 ELSE abs(mid) END AS rel FROM q),
  fc AS (SELECT *, least(1.0, greatest(0.0, CASE family WHEN 'long_straddle' THEN 0.55 ELSE 0.5 END + CASE WHEN age >= 5 THEN 0.1 ELSE 0 END + CASE WHEN rel >= 0.15 THEN 0.1 ELSE 0 END)) AS fr FROM ec)"""


@query(
    "fill_fraction_prior",
    A.sql(ECON + " SELECT snapshot_id, family, legs, round(fr::DOUBLE, 6) AS fill_fraction FROM fc", "v_options"),
)
def _(spark, sf):
    e = E.candidate_economics(candidates(spark, sf).withColumn("minutes_to_close", F.lit(90.0)))
    return e.select("snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"), r6("expected_fill_fraction", "fill_fraction"))


@query(
    "candidate_economics",
    A.sql(
        ECON + """ SELECT snapshot_id, family, legs, round((mid - fr * half)::DOUBLE, 5) AS expected_fill_price, round((mid - least(1, fr + 0.25) * half)::DOUBLE, 5) AS conservative_fill_price,
        round(greatest(0.05, 1 - 0.5 * fr)::DOUBLE, 6) AS fill_probability, round(n * 0.007, 6) AS fees, round((fr * half)::DOUBLE, 5) AS entry_slippage,
        round((least(1, fr + 0.1) * half)::DOUBLE, 5) AS exit_slippage, concat_ws(',', CASE WHEN age >= 5 THEN 'stale_quote' END, CASE WHEN rel >= 0.15 THEN 'wide_spread' END) AS flags FROM fc""",
        "v_options",
    ),
)
def _(spark, sf):
    e = E.candidate_economics(candidates(spark, sf).withColumn("minutes_to_close", F.lit(90.0)))
    r5 = lambda n: F.round(F.col(n).cast("double"), 5).alias(n)
    return e.select(
        "snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"), r5("expected_fill_price"), r5("conservative_fill_price"),
        r6("fill_probability", "fill_probability"), r6("fees", "fees"), r5("entry_slippage"), r5("exit_slippage"),
        F.array_join("quote_flags", ",").alias("flags"),
    )


@query(
    "blend_with_prior",
    "SELECT o_orderpriority AS family, round(count(*) / (count(*) + 100.0) * avg((o_orderstatus = 'F')::INT) + 100 / (count(*) + 100.0) * 0.5, 6) AS blended FROM orders GROUP BY 1",
)
def _(spark, sf):
    g = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("e")
    )
    return g.select("family", r6(E.blend_with_prior(F.col("e"), F.lit(0.5), F.col("n"))[0], "blended"))


CDF = """(CASE WHEN {x} >= 0 THEN 1 - 0.3989422804014327 * exp(-{x} * {x} / 2) * {p} ELSE 0.3989422804014327 * exp(-{x} * {x} / 2) * {p} END)"""


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    p = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return CDF.format(x=x, p=p)


@query(
    "black_prices_and_greeks",
    A.sql(
        f"""WITH b AS (SELECT snapshot_id, side, strike AS k, iv * sqrt(0.01) AS s, 25.0 AS f FROM v_chain),
      d AS (SELECT *, ln(f / k) / s + 0.5 * s AS d1, ln(f / k) / s - 0.5 * s AS d2 FROM b),
      v AS (SELECT *, f * {cdf_sql('d1')} - k * {cdf_sql('d2')} AS c, 0.3989422804014327 * exp(-d1 * d1 / 2) AS pdf, {cdf_sql('d1')} AS n1 FROM d)
      SELECT snapshot_id, side, k AS strike, round(CASE side WHEN 'call' THEN c ELSE c - f + k END, 6) AS price, round(CASE side WHEN 'call' THEN n1 ELSE n1 - 1 END, 6) AS delta,
        round(pdf / (f * s), 6) AS gamma, round(f * pdf * 0.1, 6) AS vega, round(-f * pdf * (s / 0.1) / 0.2, 5) AS theta FROM v""",
        "v_chain",
    ),
)
def _(spark, sf):
    s = F.col("iv") * F.sqrt(F.lit(0.01))
    call = F.col("side") == "call"
    g = E.black_greeks(F.lit(25.0), F.col("strike"), s, F.lit(0.01), call)
    return A.chain(spark, sf, ("iv",)).select(
        "snapshot_id", "side", "strike", r6(E.black_value(call, F.lit(25.0), F.col("strike"), s), "price"),
        r6(g["delta"], "delta"), r6(g["gamma"], "gamma"), r6(g["vega"], "vega"), F.round(g["theta"], 5).alias("theta"),
    )


@query(
    "smile_vol",
    A.sql("SELECT snapshot_id, side, strike, round(greatest(0.2 - 0.1 * ln(strike / 25) + 0.05 * ln(strike / 25) ** 2 + 0.02 * abs(ln(strike / 25)), 0.05), 6) AS total_vol FROM v_chain", "v_chain"),
)
def _(spark, sf):
    k = F.ln(F.col("strike") / 25.0)
    v = E.smile_vol(F.lit(0.2), F.lit(0.1), F.lit(0.05), F.lit(0.02), k, 0.05)
    return A.chain(spark, sf).select("snapshot_id", "side", "strike", r6(v, "total_vol"))


# -- managed exits: monthly snapshots are spread over the tape's sessions ------------------------------------------
def managed_inputs(spark, sf):
    tape = A.bars(spark, sf, 15, symbols=False)
    first = F.lit("2024-01-01").cast("date")
    month = (F.substring("snapshot_id", 1, 4).cast("int") * 12 + F.substring("snapshot_id", 6, 2).cast("int")) % 28
    c = candidates(spark, sf).withColumn("expiration", F.date_add(first, month)).withColumn(
        "observed_at", F.timestamp_seconds(F.unix_timestamp(F.col("expiration").cast("timestamp")) + 10 * 3600)
    )
    scaled = tape.select("session_date", "ts", (F.col("close") + 895.0).alias("close"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    settle = scaled.groupBy("session_date").agg(F.max_by("close", "ts").alias("settlement_price"))
    return c, scaled, minute, settle


MANAGED = PROOF + f""", cand AS (SELECT snapshot_id, family, {LEGS} AS lt, legs, credit, DATE '2024-01-01' + ((left(snapshot_id, 4)::INT * 12 + right(snapshot_id, 2)::INT) % 28)::INT AS s
        FROM b WHERE family IN {FAM_SQL} AND (loss <> 0 OR credit <> 0) AND credit <> 0),
  bars AS (SELECT session_date, ts, close + 895 AS close, hour(ts) * 60 + minute(ts) AS m FROM v_tape15),
  leg AS (SELECT c.snapshot_id, c.family, c.lt, c.credit, c.s, bars.ts, bars.m, bars.close AS f, unnest(c.legs) AS l FROM cand c JOIN bars ON bars.session_date = c.s AND bars.ts > c.s::TIMESTAMP + INTERVAL 10 HOUR),
  lv AS (SELECT g.*, l.k::DOUBLE AS k, o.iv * sqrt(greatest(960 - m, 0) / 525600.0) AS v FROM leg g JOIN v_options o ON o.snapshot_id = g.snapshot_id AND o.option_type = l.t AND o.strike = l.k),
  dv AS (SELECT *, CASE WHEN v > 0 THEN ln(f / k) / v + 0.5 * v END AS d1, CASE WHEN v > 0 THEN ln(f / k) / v - 0.5 * v END AS d2 FROM lv),
  cv AS (SELECT *, CASE WHEN v > 0 THEN f * {cdf_sql('d1')} - k * {cdf_sql('d2')} ELSE greatest(f - k, 0) END AS c FROM dv),
  mk AS (SELECT snapshot_id, family, lt, credit::DOUBLE AS credit, s, ts, m, sum(l.q * round(CASE l.t WHEN 'call' THEN c ELSE c - f + k END, 6)) AS value FROM cv GROUP BY ALL),
  rt AS (SELECT *, CASE WHEN credit > 0 THEN -(abs(value) - credit) / credit ELSE (abs(value) + credit) / -credit END AS r FROM mk),
  sg AS (SELECT *, CASE WHEN m >= 960 THEN 'expiration_settlement' WHEN r >= 0.5 THEN 'target' WHEN r <= -0.35 THEN 'stop' WHEN m >= 955 THEN 'eod' END AS reason FROM rt),
  fi AS (SELECT snapshot_id, family, lt, arg_min(reason, ts) FILTER (reason IS NOT NULL) AS reason, arg_min(credit + value, ts) FILTER (reason IS NOT NULL) AS pnl, arg_min(ts, ts) FILTER (reason IS NOT NULL) AS exit_ts FROM sg GROUP BY ALL)"""


@query(
    "managed_outcome",
    A.sql(
        MANAGED + " SELECT snapshot_id, family, reason AS exit_reason, count(*) AS n, round(sum(pnl), 3) AS total_pnl, max(epoch(exit_ts))::BIGINT AS last_exit FROM fi GROUP BY ALL",
        "v_options", "v_tape15",
    ),
)
def _(spark, sf):
    c, bars, minute, settle = managed_inputs(spark, sf)
    m = E.managed_outcome(c, E.session_paths(bars, minute), settle)
    return m.groupBy("snapshot_id", "family", "exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("realized_pnl"), 3).alias("total_pnl"),
        F.floor(F.max("exit_micros") / 1_000_000).alias("last_exit"),
    )


@query(
    "candidate_training_set",
    A.sql(
        MANAGED + """, kp AS (SELECT min(snapshot_id) AS snapshot_id FROM (SELECT DISTINCT snapshot_id, s FROM cand) GROUP BY s)
  SELECT snapshot_id, family, count(*) AS n, round(sum(pnl), 3) AS total_pnl FROM fi WHERE snapshot_id IN (SELECT snapshot_id FROM kp) GROUP BY ALL""",
        "v_options", "v_tape15",
    ),
)
def _(spark, sf):
    c, bars, minute, settle = managed_inputs(spark, sf)
    rows = E.candidate_training_set(c.withColumn("minutes_to_close", F.lit(90.0)), E.session_paths(bars, minute), settle)
    return rows.groupBy("snapshot_id", "family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("realized_pnl"), 3).alias("total_pnl"))


@query(
    "mark_structures",
    A.sql(MANAGED + " SELECT snapshot_id, family, count(*) AS n_marks, round(sum(value), 2) AS sum_value FROM mk GROUP BY ALL", "v_options", "v_tape15"),
)
def _(spark, sf):
    c, bars, minute, _ = managed_inputs(spark, sf)
    m = E.marked_paths(c, E.session_paths(bars, minute), ("family",))
    return m.groupBy("snapshot_id", "family").agg(
        F.count(F.lit(1)).alias("n_marks"), F.round(F.sum("value"), 2).alias("sum_value")
    )


@query(
    "profit_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN -(l_extendedprice / 1000 - l_quantity) / l_quantity ELSE (l_extendedprice / 1000 - l_quantity) / l_quantity END, 10) AS profit_ratio FROM lineitem""",
)
def _(spark, sf):
    r = E.profit_ratio(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_returnflag") == "R")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(r, 10).alias("profit_ratio"))


@query(
    "exit_signal",
    """SELECT sig AS signal, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 AND l_tax > 0.07 THEN 'emergency_exit' WHEN l_linenumber = 6 AND l_tax > 0.07 THEN 'expiration_settlement'
         WHEN l_linenumber = 5 AND l_tax > 0.07 THEN 'structural_ras_exit' WHEN r >= 0.5 THEN 'target' WHEN r <= -0.35 THEN 'stop' WHEN greatest(r, 0.3) - r >= 0.15 THEN 'trail' WHEN l_quantity * 10 >= 300 THEN 'time_exit'
         WHEN 930 + l_quantity >= 955 THEN 'eod' ELSE 'hold' END AS sig FROM (SELECT *, l_discount * 8 - 0.3 AS r FROM lineitem)) GROUP BY 1""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumn("r", F.col("l_discount") * 8 - 0.3)
    policy = E.ExitPolicy("trailing", max_holding_minutes=300)
    late = F.col("l_tax") > 0.07
    s = E.exit_signal(
        policy, F.col("r"), F.greatest(F.col("r"), F.lit(0.3)), F.col("l_quantity") * 10, 930 + F.col("l_quantity"),
        expired=(F.col("l_linenumber") == 6) & late, structural=(F.col("l_linenumber") == 5) & late, emergency=(F.col("l_linenumber") == 7) & late,
    )
    return li.groupBy(s.alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "settle_session",
    A.sql(
        MANAGED + """ SELECT c.snapshot_id, c.family, c.lt AS legs, (left(c.snapshot_id, 4)::INT % 2 = 0)::INT AS was_traded,
        round((credit + list_sum(list_transform(legs, lambda l: l.q * greatest(CASE WHEN l.t = 'call' THEN p - l.k ELSE l.k - p END, 0))))::DOUBLE * 2, 4) AS realized_pnl
        FROM cand c JOIN (SELECT session_date, arg_max(close, ts)::DECIMAL(18, 6) AS p FROM bars GROUP BY 1) s ON s.session_date = c.s""",
        "v_options", "v_tape15",
    ),
)
def _(spark, sf):
    c, _, _, settle = managed_inputs(spark, sf)
    pos = c.filter("entry_credit <> 0").withColumn("contracts", F.lit(2)).withColumn("was_traded", F.substring("snapshot_id", 1, 4).cast("int") % 2 == 0)
    s = E.settle_session(pos, settle)
    return s.join(c.select("snapshot_id", "candidate_id", "family", "legs"), ["snapshot_id", "candidate_id"]).select(
        "snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"), F.col("was_traded").cast("int").alias("was_traded"),
        F.round(F.col("realized_pnl").cast("double"), 4).alias("realized_pnl"),
    )


# -- sizing and risk ------------------------------------------------------------------------------------------------
@query(
    "size_contracts",
    """SELECT o_orderkey, CASE WHEN ml <= 0 OR sc <= 0 OR n < 1 THEN 0 ELSE n END AS contracts,
         CASE WHEN ml <= 0 THEN 'non_positive_max_loss' WHEN sc <= 0 THEN 'zero_budget' WHEN n < 1 THEN 'insufficient_budget' ELSE 'sized' END AS size_reason
       FROM (SELECT o_orderkey, o_custkey % 400 AS ml, (o_custkey % 4) / 4.0 AS sc, least(8, floor(least(o_totalprice * 0.02 * (o_custkey % 4) / 4.0, 4000) / nullif(o_custkey % 400, 0)))::INT AS n FROM orders)""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("equity"), F.lit(0.02).alias("risk_frac"), (F.col("o_custkey") % 4 / 4.0).alias("size_scalar"),
        (F.col("o_custkey") % 400).alias("max_loss"), F.lit(4000.0).alias("max_risk_dollars"),
    )
    return K.size_contracts(o, 8).select("o_orderkey", "contracts", "size_reason")


@query(
    "half_kelly_risk",
    A.sql(
        """WITH s AS (SELECT account_id, family, count(*) AS n, avg((pnl > 0)::INT) AS w, avg(pnl::DOUBLE) FILTER (pnl > 0) AS aw, avg(-pnl::DOUBLE) FILTER (pnl < 0) AS al FROM v_trades GROUP BY ALL)
       SELECT account_id, family, n AS n_trades, round(w - (1 - w) / (aw / al), 6) AS kelly, round(CASE WHEN n >= 30 AND al > 0 AND w > 0 AND w - (1 - w) / (aw / al) > 0
         THEN greatest(0.02, least(0.1, (w - (1 - w) / (aw / al)) * 0.5)) ELSE 0.02 END, 6) AS risk_frac FROM s""",
        "v_trades",
    ),
)
def _(spark, sf):
    h = K.half_kelly_risk(A.trades(spark, sf), ["account_id", "family"])
    return h.select("account_id", "family", "n_trades", r6("kelly", "kelly"), r6("risk_frac", "risk_frac"))


def open_positions(spark, sf):
    return A.trades(spark, sf).select(
        "account_id", "session_date", "trade_id", "family", (F.col("trade_id") % 3).cast("string").alias("expiration"),
        F.col("max_loss").cast("double").alias("max_loss"), F.lit(1).alias("contracts"), (F.col("brier") / 10).alias("gamma"), (F.col("brier") - 0.25).alias("delta"),
    )


@query(
    "portfolio_state",
    A.sql(
        """WITH f AS (SELECT account_id, session_date, family, count(*) AS n, sum(max_loss) AS r, sum(abs(brier / 10)) AS g, sum(brier - 0.25) AS d FROM v_trades GROUP BY ALL)
       SELECT account_id, session_date::VARCHAR AS session_date, sum(n)::BIGINT AS open_positions, round(sum(r)::DOUBLE, 4) AS open_risk_dollars, round(sum(g), 6) AS portfolio_gamma,
         round(sum(d), 6) AS portfolio_delta, string_agg(family || '=' || n, ',' ORDER BY family) AS families FROM f GROUP BY ALL""",
        "v_trades",
    ),
)
def _(spark, sf):
    p = K.portfolio_state(open_positions(spark, sf))
    fam = F.array_join(F.transform(F.map_entries("family_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return p.select(
        "account_id", F.col("session_date").cast("string").alias("session_date"), "open_positions", F.round(F.col("open_risk_dollars").cast("double"), 4).alias("open_risk_dollars"),
        r6("portfolio_gamma", "portfolio_gamma"), r6("portfolio_delta", "portfolio_delta"), fam.alias("families"),
    )


LIMITS = K.RiskLimits(max_daily_loss=40.0, max_positions=3, max_family_positions=1, max_expiration_positions=2)


@query("greedy_portfolio_check")
def _(spark, sf):
    p = open_positions(spark, sf).withColumn("session_date", F.trunc("session_date", "month").cast("string"))
    g = K.greedy_portfolio_check(p, LIMITS, ["trade_id"])
    return g.select("trade_id", "account_id", "session_date", F.col("accepted").cast("int").alias("accepted"), "vetoes")


def account_rows(spark, sf):
    p = K.portfolio_state(open_positions(spark, sf))
    pnl = A.trades(spark, sf).groupBy("account_id", "session_date").agg(F.sum("pnl").alias("daily_realized_pnl"), F.max("notional").alias("equity"))
    return p.join(pnl, ["account_id", "session_date"]).withColumn(
        "operational_vetoes", F.array_compact(F.array(F.when(F.dayofmonth("session_date") == 13, F.lit("market_closed"))))
    )


ENV = """WITH p AS (SELECT account_id, session_date, count(*) AS n, sum(max_loss)::DOUBLE AS r, sum(abs(brier / 10)) AS g, sum(pnl)::DOUBLE AS pnl, max(notional) AS eq FROM v_trades GROUP BY ALL),
  e AS (SELECT *, greatest(0, 60 - r - greatest(-pnl, 0)) AS daily, greatest(0, 3 - n) AS slots FROM p),
  v AS (SELECT *, CASE WHEN daily <= 0 THEN round(eq * 0.02, 4) ELSE daily END AS cap, concat_ws(',', CASE WHEN day(session_date) = 13 THEN 'market_closed' END,
     CASE WHEN daily <= 0 THEN 'daily_loss_exhausted' END, CASE WHEN slots <= 0 THEN 'max_positions' END, CASE WHEN g > 0.1205 THEN 'portfolio_gamma' END) AS vetoes FROM e)"""
ENV_LIMITS = K.RiskLimits(max_daily_loss=60.0, max_positions=3, gamma_limit=0.1205)


@query(
    "risk_envelope",
    A.sql(
        ENV + " SELECT account_id, session_date::VARCHAR AS session_date, round(daily, 4) AS remaining_daily_loss, slots AS remaining_slots, vetoes, round(CASE WHEN vetoes = '' THEN cap ELSE 0 END, 4) AS risk_dollars FROM v",
        "v_trades",
    ),
)
def _(spark, sf):
    e = K.risk_envelope(account_rows(spark, sf), ENV_LIMITS)
    return e.select(
        "account_id", F.col("session_date").cast("string").alias("session_date"), F.round("remaining_daily_loss", 4).alias("remaining_daily_loss"),
        F.col("remaining_slots"), F.array_join("envelope_vetoes", ",").alias("vetoes"), F.round("envelope_risk_dollars", 4).alias("risk_dollars"),
    )


@query(
    "risk_firewall",
    A.sql(
        ENV + """, d AS (SELECT t.trade_id, t.account_id, t.family, t.max_loss::DOUBLE AS ml, t.brier, v.* EXCLUDE (account_id) FROM v_trades t JOIN v USING (account_id, session_date))
      SELECT trade_id, CASE WHEN trade_id % 10 = 0 THEN 'order_intent' WHEN trade_id % 10 = 1 THEN 'candidate_id' ELSE concat_ws(',',
        CASE WHEN vetoes <> '' THEN 'deployment_mode' END, CASE WHEN trade_id % 19 = 0 OR vetoes <> '' THEN 'emergency_lockout' END, CASE WHEN trade_id % 23 = 0 THEN 'session_status' END,
        CASE WHEN day(session_date) = 13 THEN 'operational_vetoes' END, CASE WHEN trade_id % 8 > 5 THEN 'spot_freshness' END,
        CASE WHEN CASE WHEN vetoes = '' THEN cap ELSE 0 END > 0 AND ml > cap THEN 'maximum_loss' END, CASE WHEN brier < 0.02 THEN 'fill_estimate' END,
        CASE WHEN daily < ml THEN 'daily_realized_loss' END, CASE WHEN r + ml > 60 THEN 'open_risk' END, CASE WHEN n >= 3 THEN 'position_count' END,
        CASE WHEN g + brier / 10 > 0.1205 THEN 'gamma' END, CASE WHEN trade_id % 29 = 0 THEN 'equivalent_position' END, CASE WHEN trade_id % 31 = 0 THEN 'duplicate_order' END,
        CASE WHEN trade_id % 90 > 60 THEN 'stale_decision' END,
        CASE WHEN NOT (ml > 0 AND least(eq * least(1, CASE WHEN vetoes = '' THEN cap ELSE 0 END / eq) * CASE WHEN vetoes = '' THEN 1 ELSE 0 END, CASE WHEN vetoes = '' THEN cap ELSE 0 END) / ml + 1e-9 >= 1) THEN 'sizing' END) END AS vetoes
      FROM d""",
        "v_trades",
    ),
)
def _(spark, sf):
    env = K.risk_envelope(account_rows(spark, sf), ENV_LIMITS)
    t = A.trades(spark, sf)
    k = F.col("trade_id")
    now = F.lit("2024-01-02 15:00:00").cast("timestamp")
    d = t.select(
        "trade_id", "account_id", "session_date", "family", "max_loss", (F.col("brier") / 10).alias("gamma"), F.col("brier").alias("fill_probability"),
        F.when(k % 10 == 0, "ABSTAIN").otherwise("SELECT_CANDIDATE").alias("action"), k.cast("string").alias("selected_candidate_id"),
        F.when(k % 10 != 1, k.cast("string")).alias("candidate_id"), (k % 3).cast("string").alias("expiration"), (k % 19 == 0).alias("lockout_active"),
        (k % 23 != 0).alias("market_open"), F.lit(True).alias("data_valid"), F.lit(False).alias("entry_locked"), F.lit(False).alias("session_warmup"),
        F.lit(True).alias("journal_available"), (k % 8).cast("double").alias("spot_age"), F.lit(None).cast("double").alias("bar_age"), F.lit(1.0).alias("quote_age"),
        F.lit("g").alias("geometry_hash"), F.lit(None).cast("string").alias("expected_geometry_hash"), (k % 29 == 0).alias("equivalent_open"), (k % 31 == 0).alias("duplicate_order"),
        F.timestamp_seconds(F.unix_timestamp(now) - k % 90).alias("decided_at"), now.alias("now"), F.lit(True).alias("exit_policy_approved"),
        F.lit(1.0).alias("size_scalar"), F.lit(0).alias("requested_contracts"),
    )
    f = K.risk_firewall(d.join(env, ["account_id", "session_date"]), ENV_LIMITS, min_fill=0.02)
    return f.select("trade_id", F.array_join("vetoes", ",").alias("vetoes"))


@query(
    "execution_guard",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_custkey % 41 = 0 THEN 'trading_disabled' END, CASE WHEN o_custkey % 17 = 0 THEN 'snapshot_hard_veto' END,
       CASE WHEN mode = 'other' THEN 'unknown_mode' END, CASE WHEN mode = 'live' THEN 'live_not_permitted' END, CASE WHEN o_orderkey % 14 = 1 THEN 'candidate_not_eligible' END,
       CASE WHEN h < 570 OR h > 960 THEN 'outside_session_window' END, CASE WHEN o_custkey % 5 >= 3 THEN 'position_limit' END,
       CASE WHEN o_orderkey % 14 <> 1 AND o_totalprice / 500 > 500 THEN 'max_loss_exceeded' END, CASE WHEN o_orderkey % 14 <> 1 AND o_totalprice / 100 > 2500 THEN 'capital_exceeded' END,
       CASE WHEN o_orderkey % 14 <> 1 AND (o_custkey % 100) / 100.0 < 0.35 THEN 'fill_probability_too_low' END, CASE WHEN o_custkey % 9 > 5 THEN 'quote_stale' END, CASE WHEN o_custkey % 3 = 0 THEN 'size_not_positive' END) END AS blocks,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_custkey % 3 * 0.7 > 1 THEN 'size_scalar' END, CASE WHEN 1 + o_orderkey % 13 > 10 THEN 'contracts' END) END AS clamps
     FROM (SELECT *, ['paper', 'shadow', 'live', 'other', 'paper'][1 + o_orderkey % 5] AS mode, 560 + o_orderkey % 420 AS h FROM orders)""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    d = o.select(
        "o_orderkey", F.when(k % 6 == 0, "ABSTAIN").otherwise(" trade").alias("action"), (c % 41 != 0).alias("trading_enabled"), F.lit(True).alias("eligibility_passed"),
        F.array_compact(F.array(F.when(c % 17 == 0, F.lit("STALE_DATA")))).alias("snapshot_vetoes"),
        F.element_at(F.array(*[F.lit(m) for m in ("paper", "shadow", "live", "other", "paper")]), (k % 5 + 1).cast("int")).alias("mode"),
        k.alias("candidate_id"), F.when(k % 14 != 1, k).alias("eligible_id"), F.lit(False).alias("hard_vetoed"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-02").cast("timestamp")) + (560 + k % 420) * 60).alias("local_time"),
        (c % 5).alias("open_positions"), (p / 500).alias("maximum_loss"), (p / 100).alias("capital_required"), F.lit(None).cast("double").alias("buying_power"),
        F.lit(0).alias("family_open"), (c % 100 / 100.0).alias("fill_probability"), (c % 9).cast("double").alias("quote_age"), (c % 3 * 0.7).alias("size_scalar"),
        (1 + k % 13).alias("requested_contracts"),
    )
    g = K.execution_guard(d)
    return g.select("o_orderkey", F.array_join("blocks", ",").alias("blocks"), F.array_join("clamps", ",").alias("clamps"))


@query(
    "duplicate_decisions",
    """SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) <= INTERVAL 15 MINUTE, false)::INT AS is_duplicate FROM events""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.col("event_id").alias("decision_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("account_id"),
        (F.col("user_id") % 3).cast("string").alias("candidate_id"), F.lit("g").alias("geometry_hash"),
    )
    return K.duplicate_decisions(e).select(F.col("decision_id").alias("event_id"), F.col("is_duplicate").cast("int").alias("is_duplicate"))


@query(
    "decision_freshness",
    """SELECT event_type, CASE WHEN user_id % 11 = 0 THEN 'missing_decision_timestamp' WHEN value < 10 THEN 'decision_in_future' WHEN value > 70 THEN 'stale_decision' ELSE 'fresh' END AS freshness, count(*) AS n FROM events GROUP BY ALL""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    decided = F.when(F.col("user_id") % 11 != 0, F.timestamp_micros(F.unix_micros(ts) - F.round((F.col("value") - 10) * 1e6).cast("bigint")))
    return A.table(spark, sf, "events").groupBy("event_type", K.decision_freshness(decided, ts).alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "position_rollforward",
    """WITH f AS (SELECT user_id AS position_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE -1 END * (1 + user_id % 3) AS dq, round(value) AS price,
             CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE (round(value) - 50) * (1 + user_id % 3) END AS pnl FROM events)
       SELECT seq, sum(dq) OVER w AS open_contracts, sum(pnl) OVER w AS realized_pnl, (price - 50) * sum(dq) OVER w AS unrealized_pnl FROM f WINDOW w AS (PARTITION BY position_id ORDER BY seq)""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.col("user_id").alias("position_id"), F.col("event_id").alias("seq"), F.to_date("ts").alias("session_date"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "open").when(F.col("event_type") == "purchase", "reduce").otherwise("close").alias("event"),
        (1 + F.col("user_id") % 3).alias("contracts"), F.round("value").cast("decimal(18,4)").alias("price"), F.lit(50).cast("decimal(18,4)").alias("entry_price"),
    )
    return K.position_rollforward(e).select(
        "seq", "open_contracts", F.col("realized_pnl").cast("double").alias("realized_pnl"), F.col("unrealized_pnl").cast("double").alias("unrealized_pnl")
    )


@query(
    "account_ledger",
    """WITH f AS (SELECT o_orderkey AS seq, o_custkey % 6 AS account_id, o_orderdate AS d, CASE o_orderstatus WHEN 'F' THEN -((o_custkey % 9) * (o_custkey % 50) + 1) WHEN 'O' THEN (o_custkey % 9) * (o_custkey % 50) + 1 ELSE o_custkey % 101 - 50 END AS flow,
        CASE o_orderstatus WHEN 'P' THEN o_custkey % 101 - 50 ELSE 0 END AS pnl FROM orders)
       SELECT seq, account_id, 100000 + sum(flow) OVER w AS cash, sum(pnl) OVER w AS realized_total FROM f WINDOW w AS (PARTITION BY account_id ORDER BY d, seq)""",
)
def _(spark, sf):
    c = F.col("o_custkey")
    o = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), (c % 6).alias("account_id"), F.to_date("o_orderdate").alias("session_date"),
        F.when(F.col("o_orderstatus") == "F", "debit").when(F.col("o_orderstatus") == "O", "credit").otherwise("realize").alias("kind"),
        (c % 9).alias("quantity"), (c % 50).alias("price"), F.lit(1).alias("fees"), (c % 101 - 50).alias("realized_pnl"),
    )
    return K.account_ledger(o, "100000").select(
        "seq", "account_id", F.col("cash").cast("double").alias("cash"), F.col("realized_total").cast("double").alias("realized_total")
    )
