"""Queries: recordings, journals, folds and latest-wins views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import journal as J
from tidemark.plans import adapters as A
from tidemark.plans.registry import query


def recordings(spark, sf):
    """events as recorded lines per day: gaps where user_id % 50 = 0 was dropped, some bad hashes and bad lines."""
    e = A.table(spark, sf, "events")
    day = F.dayofmonth("ts")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    bad_hash = (day % 10 == 3) & (F.col("event_id") % 100 == 0)
    return e.filter(~((day % 3 == 0) & (F.col("user_id") % 50 == 0))).select(
        F.to_date("ts").alias("session_date"), F.col("event_id").alias("line_no"), F.col("event_id").alias("seq"),
        payload.alias("payload"), F.when(bad_hash, "sha256:0").otherwise(J.record_hash(payload)).alias("record_hash"),
        (~((day % 7 == 0) & (F.col("event_id") % 333 == 0))).alias("parsed"),
    )


REC = """WITH r AS (SELECT ts::DATE AS d, event_id AS seq, day(ts) % 10 = 3 AND event_id % 100 = 0 AS bad, NOT (day(ts) % 7 = 0 AND event_id % 333 = 0) AS parsed
    FROM events WHERE NOT (day(ts) % 3 = 0 AND user_id % 50 = 0)),
  ok AS (SELECT *, lag(seq) OVER (PARTITION BY d ORDER BY seq) AS p FROM r WHERE parsed AND NOT bad),
  rep AS (SELECT r.d, count(*) FILTER (parsed AND NOT bad) AS records, count(*) FILTER (parsed AND bad) AS hard_errors, count(*) FILTER (NOT parsed) AS skipped,
     (SELECT count(*) FROM ok WHERE ok.d = r.d AND seq <> p + 1) AS breaks FROM r GROUP BY r.d)"""


@query("verify_sequence", "WITH r AS (SELECT ts::DATE AS d, event_id AS seq FROM events WHERE user_id % 50 <> 0), l AS (SELECT *, lag(seq) OVER (PARTITION BY d ORDER BY seq) AS p FROM r) SELECT d::VARCHAR AS session_date, seq, p AS previous_seq FROM l WHERE seq <> p + 1")
def _(spark, sf):
    e = A.table(spark, sf, "events").filter("user_id % 50 <> 0").select(
        F.to_date("ts").alias("session_date"), F.col("event_id").alias("line_no"), F.col("event_id").alias("seq")
    )
    return J.verify_sequence(e, ["session_date"]).select(F.col("session_date").cast("string").alias("session_date"), "seq", "previous_seq")


@query(
    "inspect_recordings",
    REC + """ SELECT d::VARCHAR AS session_date, CASE WHEN hard_errors > 0 THEN 'unrepairable' WHEN records = 0 THEN 'empty' WHEN breaks > 0 THEN 'sequence_gap' ELSE 'clean' END AS status,
      records, hard_errors, breaks AS sequence_breaks, skipped FROM rep""",
)
def _(spark, sf):
    return J.inspect_recordings(recordings(spark, sf), ["session_date"]).withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "repair_recordings",
    REC + """ SELECT r.d::VARCHAR AS session_date, r.seq AS line_no, row_number() OVER (PARTITION BY r.d ORDER BY r.seq) - 1 AS seq FROM r JOIN rep USING (d)
      WHERE parsed AND hard_errors = 0 AND breaks > 0""",
)
def _(spark, sf):
    return J.repair_recordings(recordings(spark, sf), ["session_date"]).select(
        F.col("session_date").cast("string").alias("session_date"), "line_no", "seq"
    )


@query("renumber", "SELECT event_id AS line_no, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events")
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_type", F.col("event_id").alias("line_no"), F.lit(0).alias("seq"))
    return J.renumber(e, ["event_type"]).select("line_no", "seq")


CHAIN = """WITH RECURSIVE e AS (SELECT conv_id AS chain, turn + 1 AS s, role AS status, sha256(text) AS ph FROM conversations),
  c AS (SELECT chain, s, status, ph, NULL::VARCHAR AS prev, sha256(chain || '|' || s || '|' || status || '|' || ph || '|') AS h FROM e WHERE s = 1
        UNION ALL SELECT e.chain, e.s, e.status, e.ph, c.h, sha256(e.chain || '|' || e.s || '|' || e.status || '|' || e.ph || '|' || c.h) FROM e JOIN c ON e.chain = c.chain AND e.s = c.s + 1)"""


@query("build_hash_chain", CHAIN + " SELECT chain, s AS sequence_number, prev AS previous_event_hash, h AS event_hash FROM c")
def _(spark, sf):
    return J.build_hash_chain(A.journal(spark, sf)).select("chain", "sequence_number", "previous_event_hash", "event_hash")


@query(
    "verify_hash_chain",
    "SELECT conv_id AS chain, count(*) AS events, CASE WHEN conv_id % 10 = 0 AND count(*) >= 2 THEN 1 ELSE 0 END AS broken, (NOT (conv_id % 10 = 0 AND count(*) >= 2))::INT AS verified FROM conversations GROUP BY 1",
)
def _(spark, sf):
    built = J.build_hash_chain(A.journal(spark, sf))
    # tamper the second payload of every tenth chain
    tampered = built.withColumn(
        "payload", F.when((F.col("chain") % 10 == 0) & (F.col("sequence_number") == 2), F.lit("changed")).otherwise(F.col("payload"))
    )
    v = J.verify_hash_chain(tampered)
    return v.select("chain", "events", "broken", F.col("verified").cast("int").alias("verified"))


ROLE_STEPS = {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@query(
    "validate_transitions",
    """WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
       SELECT conv_id AS chain, turn + 1 AS sequence_number, (p IS NULL OR (p = 'system' AND role = 'user') OR (p = 'user' AND role = 'assistant') OR (p = 'assistant' AND role = 'user'))::INT AS valid FROM l""",
)
def _(spark, sf):
    v = J.validate_transitions(A.journal(spark, sf), "chain", "sequence_number", ROLE_STEPS)
    return v.select("chain", "sequence_number", F.col("valid").cast("int").alias("valid"))


@query(
    "order_state_transitions",
    """WITH s AS (SELECT user_id AS k, event_id, ['CREATED', 'VALIDATED', 'ROUTED', 'ACKNOWLEDGED', 'FILLED', 'CANCELED'][1 + (event_id * 7 + user_id) % 6] AS st FROM events),
       l AS (SELECT *, lag(st) OVER (PARTITION BY k ORDER BY event_id) AS p FROM s)
       SELECT st AS status, count(*) FILTER (p IS NULL OR (p = 'CREATED' AND st IN ('VALIDATED', 'ROUTED', 'CANCELED')) OR (p = 'VALIDATED' AND st = 'ROUTED') OR (p = 'ROUTED' AND st IN ('ACKNOWLEDGED', 'FILLED', 'CANCELED'))
         OR (p = 'ACKNOWLEDGED' AND st = 'FILLED')) AS valid, count(*) AS n FROM l GROUP BY 1""",
)
def _(spark, sf):
    names = ["CREATED", "VALIDATED", "ROUTED", "ACKNOWLEDGED", "FILLED", "CANCELED"]
    e = A.table(spark, sf, "events").select(
        "user_id", "event_id",
        F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int")).alias("status"),
    )
    v = J.validate_transitions(e, "user_id", "event_id", J.ORDER_TRANSITIONS)
    return v.groupBy("status").agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n"))


def journal_events(spark, sf):
    e = A.table(spark, sf, "events")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("sequence_number"), u.cast("string").alias("aggregate_id"),
        F.when(F.col("event_type") == "click", "order_filled").when(F.col("event_type") == "view", "order_rejected").when(F.col("event_type") == "signup", "position_marked")
        .when(F.col("event_type") == "purchase", "outcome_settled").otherwise("counterfactual_settled").alias("event_type"),
        F.when(F.col("event_id") % 3 == 0, (u % 6).cast("string")).alias("account_id"), F.when(F.col("event_id") % 4 != 0, F.round("value").cast("string")).alias("candidate_id"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 9).alias("filled_contracts"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7).alias("open_contracts"),
        F.round("value", 2).alias("realized_pnl"), (F.col("event_id") % 500).cast("string").alias("record_id"), F.to_date("ts").cast("string").alias("session_date"),
    )


@query(
    "order_projection",
    """SELECT user_id::VARCHAR AS aggregate_id, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'FILLED' ELSE 'REJECTED' END AS status,
       arg_max((user_id % 6)::VARCHAR, event_id) FILTER (event_id % 3 = 0) AS account_id, coalesce(arg_max(event_id % 9, event_id) FILTER (event_id % 5 = 0), 0) AS filled_contracts
       FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""",
)
def _(spark, sf):
    return J.journal_projections(journal_events(spark, sf))["orders"].select("aggregate_id", "status", "account_id", "filled_contracts")


@query(
    "session_projection",
    """SELECT ts::DATE::VARCHAR AS session_date, count(*) AS event_count, count(*) FILTER (event_type = 'purchase') AS outcomes, round(coalesce(sum(round(value, 2)) FILTER (event_type = 'purchase'), 0), 2) AS realized_pnl_total
       FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""",
)
def _(spark, sf):
    s = J.journal_projections(journal_events(spark, sf))["sessions"]
    return s.select("session_date", "event_count", "outcomes", F.round("realized_pnl_total", 2).alias("realized_pnl_total"))


@query(
    "rebuild_projections",
    "SELECT count(*) AS orders FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 0 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 1))",
)
def _(spark, sf):
    built = J.build_hash_chain(A.journal(spark, sf))
    tampered = built.withColumn(
        "payload", F.when((F.col("chain") % 10 == 0) & (F.col("sequence_number") == 2), F.lit("changed")).otherwise(F.col("payload"))
    )
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    ev = tampered.select(
        "*", F.concat(F.lit("order_"), F.col("status")).alias("event_type"), F.col("chain").cast("string").alias("aggregate_id"), null("string", "account_id"),
        null("string", "candidate_id"), null("bigint", "filled_contracts"), null("bigint", "open_contracts"), null("double", "realized_pnl"), null("string", "record_id"), null("string", "session_date"),
    )
    return J.rebuild(ev)[1]["orders"].agg(F.count(F.lit(1)).alias("orders"))


@query("table_fingerprint", "SELECT 'orders' AS name, count(*) AS n_rows, 1 AS same_in_any_order FROM orders")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    a = J.fingerprint(o)
    b = J.fingerprint(o.repartition(5, "o_custkey")).withColumnRenamed("n_rows", "m")
    return a.join(b, ["hash_sum", "digest_sum"], "left").select(
        F.lit("orders").alias("name"), "n_rows", (F.col("m") == F.col("n_rows")).cast("int").alias("same_in_any_order")
    )


@query("latest_wins_log", "SELECT user_id AS id, arg_max(round(value, 2), event_id) AS value, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1")
def _(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.round("value", 2).alias("value"), F.col("event_type").alias("kind"), "event_id")
    return J.latest_wins(e, "id", ["event_id"]).select("id", "value", "kind")


@query(
    "open_gaps",
    """SELECT archetype, round(epoch(max(ts))) AS observed FROM (SELECT 'a' || user_id AS archetype, ts, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events)
       WHERE r = 1 AND event_type IN ('error', 'click') AND value > 20 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("archetype"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(F.col("event_type").isin("error", "click") & (F.col("value") > 20), "weak_archetype").otherwise("cleared").alias("kind"),
    )
    g = J.open_gaps(e, F.lit("2024-01-31").cast("timestamp"))
    return g.select("archetype", F.round(F.unix_micros("observed_at") / 1e6).alias("observed"))


@query(
    "set_difference",
    "SELECT o_custkey AS id, 'left' AS side FROM orders GROUP BY 1 HAVING o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def _(spark, sf):
    left = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    right = A.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    return J.set_difference(left, right)


def fold_sql(roles: str) -> str:
    return f"""WITH s AS (SELECT DISTINCT ts::DATE AS d FROM events), k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM s),
      g AS (SELECT *, greatest(2, (n - 8) // 4) AS st FROM k), f AS (SELECT g.*, fold, 8 + fold * (st + 1) AS te FROM g, (SELECT unnest([0, 1, 2, 3]) AS fold)),
      b AS (SELECT *, least(te + 1, n) AS ts, least(least(te + 1, n) + st, n) AS tz FROM f), {roles}
      SELECT fold, d::VARCHAR AS session_date, role FROM z WHERE ts < tz AND role IS NOT NULL"""


@query(
    "expanding_folds",
    fold_sql("z AS (SELECT *, CASE WHEN r < te THEN 'train' WHEN r < ts THEN 'embargo' WHEN r < tz THEN 'test' END AS role FROM b)"),
)
def _(spark, sf):
    s = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date"))
    return J.expanding_folds(s).withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "nested_folds",
    fold_sql(
        """c AS (SELECT *, CASE WHEN te - least(2, round_even(te * 0.2, 0)) < 8 THEN 0 ELSE least(2, round_even(te * 0.2, 0)) END::INT AS nc FROM b),
        z AS (SELECT *, CASE WHEN nc > 0 AND te - nc - 1 >= 8 THEN CASE WHEN r < te - nc - 1 THEN 'train' WHEN r < te - nc THEN 'embargo' WHEN r < te THEN 'calibration' WHEN r < ts THEN 'embargo' WHEN r < tz THEN 'test' END
          ELSE CASE WHEN r < te THEN 'train' WHEN r < ts THEN 'embargo' WHEN r < tz THEN 'test' END END AS role FROM c)"""
    ),
)
def _(spark, sf):
    s = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date"))
    return J.expanding_folds(s, calibration=0.2).withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "prequential_walk",
    """WITH s AS (SELECT ts::DATE AS d, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS r FROM s)
       SELECT d::VARCHAR AS session_date, round(c - b, 6) AS forward_transfer FROM r WHERE r >= 3 AND d <> DATE '2024-01-15'""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    s = e.groupBy(F.to_date("ts").alias("session_date")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("champion"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("baseline")
    )
    w = J.prequential_walk(s, sealed=["2024-01-15"])
    return w.select(F.col("session_date").cast("string").alias("session_date"), r6("forward_transfer", "forward_transfer"))


@query(
    "thin_by_interval",
    """WITH RECURSIVE e AS (SELECT event_type AS k, ts::DATE AS d, ts, event_id FROM events), t AS (SELECT k, d, min(ts) AS ts FROM e GROUP BY ALL
       UNION ALL SELECT t.k, t.d, (SELECT min(e.ts) FROM e WHERE e.k = t.k AND e.d = t.d AND e.ts >= t.ts + INTERVAL 60 MINUTE) FROM t WHERE t.ts IS NOT NULL)
       SELECT e.event_id FROM t JOIN e ON e.k = t.k AND e.d = t.d AND e.ts = t.ts""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("ts"))
    return J.thin_by_interval(e, ["event_type", "session_date"], seconds=3600, tie=["event_id"]).select("event_id")


@query("recent_sessions", "SELECT event_id FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 DESC LIMIT 3)")
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("session_date"))
    return J.recent_sessions(e, 3).select("event_id")
