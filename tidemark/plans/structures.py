"""Queries: structure enumeration, payoffs, identity and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import structures as S
from tidemark.plans import adapters as A
from tidemark.plans.registry import query

# Every family as SQL joins on the chain: legs (s1,k1,q1) … (s4,k4,q4); absent legs are NULL.
ENUM = """
WITH c AS (SELECT snapshot_id, strike AS k, mid, ask - bid AS spread FROM v_options WHERE option_type = 'call'),
p AS (SELECT snapshot_id, strike AS k, mid, ask - bid AS spread FROM v_options WHERE option_type = 'put'),
w AS (SELECT unnest([1, 2, 3, 5])::DECIMAL(18, 6) AS w),
sc AS (SELECT * FROM c WHERE k - 1000 BETWEEN 1.5 AND 30), sp AS (SELECT * FROM p WHERE 1000 - k BETWEEN 1.5 AND 30),
lc AS (SELECT * FROM c WHERE k - 1000 BETWEEN -5 AND 15), lp AS (SELECT * FROM p WHERE 1000 - k BETWEEN -5 AND 15),
atm AS (SELECT snapshot_id, arg_min(strike, (abs(strike - 1000), strike)) AS k FROM v_options GROUP BY 1),
e AS (
 SELECT a.snapshot_id, 'bull_put_credit_spread' AS family, [{'t': 'put', 'k': a.k, 'q': -1, 'm': a.mid}, {'t': 'put', 'k': b.k, 'q': 1, 'm': b.mid}] AS legs
   FROM sp a JOIN w ON true JOIN p b ON b.snapshot_id = a.snapshot_id AND b.k = a.k - w.w
 UNION ALL SELECT a.snapshot_id, 'bear_call_credit_spread', [{'t': 'call', 'k': a.k, 'q': -1, 'm': a.mid}, {'t': 'call', 'k': b.k, 'q': 1, 'm': b.mid}]
   FROM sc a JOIN w ON true JOIN c b ON b.snapshot_id = a.snapshot_id AND b.k = a.k + w.w
 UNION ALL SELECT a.snapshot_id, 'call_debit_spread', [{'t': 'call', 'k': a.k, 'q': 1, 'm': a.mid}, {'t': 'call', 'k': b.k, 'q': -1, 'm': b.mid}]
   FROM lc a JOIN w ON true JOIN c b ON b.snapshot_id = a.snapshot_id AND b.k = a.k + w.w
 UNION ALL SELECT a.snapshot_id, 'put_debit_spread', [{'t': 'put', 'k': a.k, 'q': 1, 'm': a.mid}, {'t': 'put', 'k': b.k, 'q': -1, 'm': b.mid}]
   FROM lp a JOIN w ON true JOIN p b ON b.snapshot_id = a.snapshot_id AND b.k = a.k - w.w
 UNION ALL SELECT snapshot_id, 'long_call', [{'t': 'call', 'k': k, 'q': 1, 'm': mid}] FROM lc
 UNION ALL SELECT snapshot_id, 'long_put', [{'t': 'put', 'k': k, 'q': 1, 'm': mid}] FROM lp
 UNION ALL SELECT a.snapshot_id, 'iron_condor', [{'t': 'put', 'k': a.k, 'q': -1, 'm': a.mid}, {'t': 'put', 'k': b.k, 'q': 1, 'm': b.mid},
     {'t': 'call', 'k': x.k, 'q': -1, 'm': x.mid}, {'t': 'call', 'k': y.k, 'q': 1, 'm': y.mid}]
   FROM sp a JOIN w ON true JOIN p b ON b.snapshot_id = a.snapshot_id AND b.k = a.k - w.w
   JOIN sc x ON x.snapshot_id = a.snapshot_id AND abs((1000 - a.k) - (x.k - 1000)) <= 10
   JOIN c y ON y.snapshot_id = a.snapshot_id AND y.k = x.k + w.w
 UNION ALL SELECT atm.snapshot_id, 'iron_butterfly', [{'t': 'put', 'k': a.k, 'q': -1, 'm': a.mid}, {'t': 'put', 'k': b.k, 'q': 1, 'm': b.mid},
     {'t': 'call', 'k': x.k, 'q': -1, 'm': x.mid}, {'t': 'call', 'k': y.k, 'q': 1, 'm': y.mid}]
   FROM atm JOIN w ON true JOIN p a ON a.snapshot_id = atm.snapshot_id AND a.k = atm.k JOIN p b ON b.snapshot_id = atm.snapshot_id AND b.k = atm.k - w.w
   JOIN c x ON x.snapshot_id = atm.snapshot_id AND x.k = atm.k JOIN c y ON y.snapshot_id = atm.snapshot_id AND y.k = atm.k + w.w
 UNION ALL SELECT atm.snapshot_id, 'bounded_broken_wing_butterfly', [{'t': 'put', 'k': u.k, 'q': 1, 'm': u.mid}, {'t': 'put', 'k': b.k, 'q': -2, 'm': b.mid},
     {'t': 'put', 'k': l.k, 'q': 1, 'm': l.mid}]
   FROM atm JOIN w n ON true JOIN w f ON f.w > n.w JOIN p u ON u.snapshot_id = atm.snapshot_id AND u.k = atm.k + n.w
   JOIN p b ON b.snapshot_id = atm.snapshot_id AND b.k = atm.k JOIN p l ON l.snapshot_id = atm.snapshot_id AND l.k = atm.k - f.w
 UNION ALL SELECT atm.snapshot_id, 'long_straddle', [{'t': 'call', 'k': x.k, 'q': 1, 'm': x.mid}, {'t': 'put', 'k': a.k, 'q': 1, 'm': a.mid}]
   FROM atm JOIN c x ON x.snapshot_id = atm.snapshot_id AND x.k = atm.k JOIN p a ON a.snapshot_id = atm.snapshot_id AND a.k = atm.k
 UNION ALL SELECT x.snapshot_id, 'long_strangle', [{'t': 'call', 'k': x.k, 'q': 1, 'm': x.mid}, {'t': 'put', 'k': a.k, 'q': 1, 'm': a.mid}]
   FROM sc x JOIN sp a ON a.snapshot_id = x.snapshot_id AND abs((x.k - 1000) - (1000 - a.k)) < (x.k - 1000) * 0.5
 UNION ALL SELECT s.snapshot_id, 'bounded_backspread_call', [{'t': 'call', 'k': s.k, 'q': -1, 'm': s.mid}, {'t': 'call', 'k': b.k, 'q': 2, 'm': b.mid}]
   FROM lc s JOIN sc b ON b.snapshot_id = s.snapshot_id AND b.k > s.k
 UNION ALL SELECT s.snapshot_id, 'bounded_backspread_put', [{'t': 'put', 'k': s.k, 'q': -1, 'm': s.mid}, {'t': 'put', 'k': b.k, 'q': 2, 'm': b.mid}]
   FROM lp s JOIN sp b ON b.snapshot_id = s.snapshot_id AND b.k < s.k),
x AS (SELECT snapshot_id, family, list_sort(legs) AS legs, list_sum(list_transform(legs, lambda l: -l.q * l.m))::DECIMAL(18, 6) AS credit,
        list_sum(list_transform(legs, lambda l: CASE WHEN l.t = 'call' THEN l.q ELSE 0 END)) AS net_calls,
        list_sort(list_distinct(list_transform(legs, lambda l: l.k))) AS ks FROM e)
"""
# Worst and best payoff from the structure's own corners: piecewise linear between 0, its strikes and a far point.
PROOF = ENUM + """,
y AS (SELECT *, list_concat([0::DECIMAL(18, 6)], ks, [(ks[-1] + greatest(ks[-1] - ks[1], 1) * 10)::DECIMAL(18, 6)]) AS ss FROM x),
z AS (SELECT *, list_transform(ss, lambda s: (credit + list_sum(list_transform(legs, lambda l: l.q * greatest(CASE WHEN l.t = 'call' THEN s - l.k ELSE l.k - s END, 0))))::DECIMAL(18, 6)) AS pp FROM y),
b AS (SELECT *, CASE WHEN list_min(pp) >= 0 AND credit <= 0 THEN greatest(-credit, 0) ELSE greatest(-list_min(pp), 0) END AS loss,
        CASE WHEN net_calls = 0 THEN greatest(list_max(pp), 0) END AS profit FROM z WHERE net_calls >= 0)
"""
LEGS = "array_to_string(list_transform(legs, lambda l: l.t || ':' || l.k || ':' || l.q), ',')"
DIRECTIONAL = ("long_call", "long_put", "call_debit_spread", "put_debit_spread", "long_straddle")


@query(
    "enumerate_structures",
    A.sql(
        ENUM + """ SELECT snapshot_id, family, count(*) AS n, round(sum(list_sum(list_transform(legs, lambda l: l.k * l.q)))::DOUBLE, 4) AS strike_sum
        FROM x GROUP BY ALL""",
        "v_options",
    ),
)
def _(spark, sf):
    s = S.enumerate_structures(A.options(spark, sf))
    total = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["quantity"] * x["strike"].cast("double"))
    return s.groupBy("snapshot_id", "family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("strike_sum")
    )


@query(
    "credit_verticals",
    A.sql(ENUM + f" SELECT snapshot_id, family, {LEGS} AS legs, round(credit::DOUBLE, 6) AS entry_credit FROM x WHERE family IN ('bull_put_credit_spread', 'bear_call_credit_spread')", "v_options"),
)
def _(spark, sf):
    cfg = S.StructureConfig(families=("bull_put_credit_spread", "bear_call_credit_spread"))
    s = S.enumerate_structures(A.options(spark, sf), cfg)
    return s.select("snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"), r6(S.entry_credit(), "entry_credit"))


@query(
    "iron_condors",
    A.sql(
        ENUM + """ SELECT snapshot_id, count(*) AS n, round(sum(credit)::DOUBLE, 4) AS sum_credit, round(max(credit)::DOUBLE, 6) AS best_credit
        FROM x WHERE family = 'iron_condor' GROUP BY 1""",
        "v_options",
    ),
)
def _(spark, sf):
    s = S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=("iron_condor",)))
    cr = s.withColumn("c", S.entry_credit())
    return cr.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("c").cast("double"), 4).alias("sum_credit"),
        r6(F.max("c"), "best_credit"),
    )


SMALL = "('long_call', 'long_put', 'call_debit_spread', 'put_debit_spread', 'long_straddle')"


@query(
    "prove_bounded_loss",
    A.sql(
        PROOF + f""" SELECT snapshot_id, family, {LEGS} AS legs, round(credit::DOUBLE, 6) AS entry_credit, round(loss::DOUBLE, 6) AS maximum_loss,
        round(profit::DOUBLE, 6) AS maximum_profit, round(greatest(loss, -credit, 0)::DOUBLE, 6) AS capital_required
        FROM b WHERE family NOT IN ('iron_condor', 'long_strangle') AND (loss <> 0 OR credit <> 0)""",
        "v_options",
    ),
)
def _(spark, sf):
    fams = tuple(f for f in S.DIRECTION if f not in ("iron_condor", "long_strangle"))
    p = S.prove_bounded_loss(S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=fams)))
    return p.select(
        "snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"),
        *[r6(c, c) for c in ("entry_credit", "maximum_loss", "maximum_profit", "capital_required")],
    )


@query(
    "terminal_payoff",
    A.sql(
        ENUM + f""" SELECT snapshot_id, family, {LEGS} AS legs,
        round((credit + list_sum(list_transform(legs, lambda l: l.q * greatest(CASE WHEN l.t = 'call' THEN 1003 - l.k ELSE l.k - 1003 END, 0))))::DOUBLE, 6) AS pnl
        FROM x WHERE family IN {SMALL}""",
        "v_options",
    ),
)
def _(spark, sf):
    s = S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=DIRECTIONAL))
    return s.select(
        "snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"),
        r6(S.terminal_payoff(F.col("legs"), S.entry_credit(), S.dec(1003)), "pnl"),
    )


@query(
    "breakevens",
    A.sql(
        PROOF + f""", q AS (SELECT snapshot_id, family, {LEGS} AS legs, unnest(range(1, len(ss) + 1)) AS i, ss, pp FROM b WHERE family = 'call_debit_spread' AND (loss <> 0 OR credit <> 0)),
        h AS (SELECT snapshot_id, legs, CASE WHEN pp[i] = 0 THEN ss[i]::DOUBLE WHEN pp[i]::DOUBLE * pp[i + 1]::DOUBLE < 0
                     THEN ss[i]::DOUBLE + (ss[i + 1] - ss[i])::DOUBLE * pp[i]::DOUBLE / (pp[i] - pp[i + 1])::DOUBLE END AS be FROM q)
        SELECT snapshot_id, legs, count(be) AS n, round(sum(be), 5) AS sum_be FROM h GROUP BY ALL""",
        "v_options",
    ),
)
def _(spark, sf):
    p = S.prove_bounded_loss(
        S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=("call_debit_spread",)))
    ).withColumn("be", S.breakevens(F.col("spots"), F.col("payoffs")))
    total = F.aggregate("be", F.lit(0.0), lambda a, x: a + x)
    return p.select(
        "snapshot_id", S.legs_text(F.col("legs")).alias("legs"), F.size("be").cast("bigint").alias("n"),
        F.when(F.size("be") > 0, F.round(total, 5)).alias("sum_be"),
    )


@query(
    "candidate_identity",
    A.sql(
        PROOF + f""", g AS (SELECT *, sha256('1|' || family || '|' || snapshot_id || '-28|' || {LEGS}) AS geometry_hash FROM b
                WHERE family IN {SMALL} AND (loss <> 0 OR credit <> 0))
        SELECT snapshot_id, family, geometry_hash, 'cand-' || sha256(snapshot_id || '|1|' || geometry_hash)[1:12] AS candidate_id,
               CASE WHEN credit > 0 THEN 'credit' WHEN credit < 0 THEN 'debit' ELSE 'even' END AS entry_type FROM g""",
        "v_options",
    ),
)
def _(spark, sf):
    s = S.with_identity(
        S.prove_bounded_loss(S.enumerate_structures(A.options(spark, sf), S.StructureConfig(families=DIRECTIONAL)))
    )
    return s.select("snapshot_id", "family", "geometry_hash", "candidate_id", "entry_type")


def universe(spark, sf, families=None):
    return S.candidate_universe(A.options(spark, sf), S.StructureConfig(families=families))


@query(
    "dominance_pruning",
    A.sql(
        PROOF + f""", u AS (SELECT snapshot_id, family, {LEGS} AS lt, legs, credit, ks FROM b
                WHERE family IN ('call_debit_spread', 'bear_call_credit_spread', 'long_call') AND (loss <> 0 OR credit <> 0)),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, lt ORDER BY family) AS r1 FROM u)),
        gk AS (SELECT snapshot_id, list_sort(list_distinct(flatten(list(ks)))) AS g FROM d GROUP BY 1),
        cv AS (SELECT d.snapshot_id, family, lt, credit, list_transform(list_concat([0::DECIMAL(18, 6)], g, [g[-1] + 50]), lambda s:
                  (credit + list_sum(list_transform(legs, lambda l: l.q * greatest(CASE WHEN l.t = 'call' THEN s - l.k ELSE l.k - s END, 0))))::DECIMAL(18, 6)) AS v
               FROM d JOIN gk USING (snapshot_id)),
        t AS (SELECT *, list_sum(v) AS a FROM cv)
        SELECT snapshot_id, family, lt AS legs FROM t b WHERE NOT EXISTS (SELECT 1 FROM t a WHERE a.snapshot_id = b.snapshot_id AND a.credit >= b.credit
           AND a.a > b.a AND a.v[1] >= b.v[1] AND a.v[-1] >= b.v[-1] AND list_bool_and(list_transform(list_zip(a.v, b.v), lambda z: z[1] >= z[2])))""",
        "v_options",
    ),
)
def _(spark, sf):
    return universe(spark, sf, ("call_debit_spread", "bear_call_credit_spread", "long_call")).select("snapshot_id", "family", S.legs_text(F.col("legs")).alias("legs"))


@query("candidate_universe")
def _(spark, sf):
    u = S.universe_ids(universe(spark, sf))  # all 13 families
    return u.select("snapshot_id", "n_candidates", "universe_id")


@query(
    "dedupe_candidates",
    """WITH e AS (SELECT event_type AS snapshot_id, 'g' || user_id AS geometry_hash, round(value) AS entry_credit, user_id % 7 AS quote_quality, event_id FROM events),
       g AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, geometry_hash ORDER BY quote_quality DESC, 'c' || lpad(event_id::VARCHAR, 12, '0')) AS r FROM e),
       h AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, entry_credit ORDER BY 'c' || lpad(event_id::VARCHAR, 12, '0')) AS q FROM g WHERE r = 1)
       SELECT snapshot_id, geometry_hash, event_id, entry_credit FROM h WHERE q = 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.col("event_type").alias("snapshot_id"),
        F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("geometry_hash"),
        F.round("value").alias("entry_credit"),
        (F.col("user_id") % 7).alias("quote_quality"),
        F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("candidate_id"),
        "event_id",
    ).withColumn("payoff_hash", F.col("entry_credit").cast("string"))
    return S.dedupe_by_payoff(S.dedupe_by_geometry(e)).select("snapshot_id", "geometry_hash", "event_id", "entry_credit")
