"""Market-shaped views over the given tables, as DataFrames and as SQL text for the oracle.

The tables carry no option data, so each view maps their columns deterministically onto the engine's inputs.
Every view covers its whole table and is built with map-side aggregation where several rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import bars_from_ticks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """events as ticks: symbol, ts, price, size, seq."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(100.0) + F.col("value") / 10.0).alias("price"),
        (F.lit(1) + F.col("user_id") % 10).alias("size"),
        F.col("event_id").alias("seq"),
    )


def bars(spark: SparkSession, sf: str, minutes: int = 30, symbols: bool = True) -> DataFrame:
    """Bars of the ticks at a width; per event type, or of the whole tape as one symbol."""
    t = ticks(spark, sf)
    if not symbols:
        t = t.withColumn("symbol", F.lit("ALL"))
    return bars_from_ticks(t, minutes, tz=None).drop("bucket")


def block_month() -> Column:
    return F.concat_ws("-", F.date_format("l_shipdate", "yyyy-MM"), F.floor(F.col("l_orderkey") / 1000).cast("string"))


BLOCK_MONTH_SQL = "strftime(l_shipdate, '%Y-%m') || '-' || (l_orderkey // 1000)"


CHAIN = ("gamma", "delta", "open_interest", "volume", "bid", "ask", "mark", "last", "iv")


def chain(spark: SparkSession, sf: str, columns: tuple[str, ...] = CHAIN, together: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """lineitem as option quotes: a snapshot is a month of a thousand orders and holds the first line per (side, strike).

    Snapshots grow with the orders, so most lines stay at every scale. The pick is a min_by aggregate, combined map-side;
    only the `columns` that a query reads are sorted and moved. together: lines move once, by their snapshot, and all that
    follows per snapshot is done where they are (for queries that put several families together). lines: rows of lineitem with
    their snapshot_id, read in place of the table.
    """
    values = {
        "gamma": F.col("l_discount").alias("gamma"),
        "delta": (F.col("l_tax") * 10 - F.lit(0.4)).alias("delta"),
        "open_interest": F.col("l_extendedprice").cast("bigint").alias("open_interest"),
        "volume": (F.col("l_partkey") % 500).alias("volume"),
        "bid": (F.col("l_extendedprice") / 1000.0).alias("bid"),
        "ask": (F.col("l_extendedprice") / 1000.0 * (F.lit(1.0) + F.col("l_tax"))).alias("ask"),
        "mark": F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 990.0).alias("mark"),
        "last": (F.col("l_extendedprice") / 1010.0).alias("last"),
        "iv": (F.lit(0.1) + F.col("l_discount")).alias("iv"),
    }
    raw = table(spark, sf, "lineitem").withColumn("snapshot_id", block_month()) if lines is None else lines
    li = raw.select(
        "snapshot_id",
        F.when(F.col("l_linenumber") % 2 == 0, "put").otherwise("call").alias("side"),
        F.col("l_quantity").alias("strike"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.struct(*[values[n] for n in columns]).alias("q"),
    )
    return (
        (li.repartition("snapshot_id") if together else li).groupBy("snapshot_id", "side", "strike")
        .agg(F.min("pos").alias("p"), F.min_by("q", "pos").alias("q"))
        .select(
            "snapshot_id", "side", "strike", F.lit(25.0).alias("spot"),
            (F.col("p.l_orderkey") * 8 + F.col("p.l_linenumber")).alias("pos"), "q.*",
        )
    )


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as raw contract rows (one per line, many per strike), for the additive chain aggregates."""
    return table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "put").otherwise("call").alias("side"),
        F.col("l_quantity").alias("strike"),
        F.lit(25.0).alias("spot"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.col("l_discount").alias("gamma"),
        F.col("l_extendedprice").cast("bigint").alias("open_interest"),
        (F.col("l_partkey") % 500).alias("volume"),
    )


def options(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a tradeable chain around spot 1000: unit strikes, prices in whole cents, one contract per side."""
    cents = F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    li = table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "put").otherwise("call").alias("option_type"),
        (F.col("l_quantity").cast("int") + 975).cast("decimal(18,6)").alias("strike"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.struct(
            (cents / F.lit(100)).cast("decimal(18,6)").alias("bid"),
            ((cents + 1 + F.col("l_linenumber")) / F.lit(100)).cast("decimal(18,6)").alias("ask"),
            (F.lit(0.1) + F.col("l_discount")).alias("iv"),
            (F.col("l_partkey") % 8).cast("double").alias("age_seconds"),
        ).alias("q"),
    )
    return (
        li.groupBy("snapshot_id", "option_type", "strike")
        .agg(F.min_by("q", "pos").alias("q"))
        .select(
            "snapshot_id",
            "option_type",
            "strike",
            F.concat_ws("-", F.col("option_type"), F.col("strike").cast("int").cast("string")).alias("contract_id"),
            F.to_date(F.concat("snapshot_id", F.lit("-28"))).alias("expiration"),
            F.lit(1000).cast("decimal(18,6)").alias("spot"),
            F.col("q.bid"), F.col("q.ask"), F.lit(None).cast("decimal(18,6)").alias("mark"),
            F.lit(None).cast("decimal(18,6)").alias("last"), F.col("q.iv"), F.col("q.age_seconds"),
        )
    )


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """events as feed observations: age = value seconds, snapshot = hour."""
    e = table(spark, sf, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("snapshot_id"),
        F.col("event_type").alias("component"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        (F.col("user_id") % 3).cast("int").alias("attempt_order"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.when(F.col("user_id") % 17 != 0, F.col("value") - 1.0).alias("age_seconds"),
        F.lit(20.0).alias("freshness_limit_seconds"),
        (F.col("user_id") % 5 == 0).alias("fallback_used"),
        F.col("event_id").alias("seq"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """orders ⋈ lineitem as settled trades, one per order with at least one line."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_discount").cast("decimal(12,2)")).alias("disc"),
        F.sum(F.col("l_tax").cast("decimal(12,2)")).alias("tax"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_quantity").alias("max_qty"),
    )
    key = F.col("o_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        key.alias("trade_id"),
        F.to_date("o_orderdate").alias("session_date"),
        (F.col("o_custkey") % 6).alias("account_id"),
        F.col("o_orderpriority").alias("family"),
        F.concat(F.lit("v"), (key % 3).cast("string")).alias("variant"),
        ((F.col("disc") - F.col("tax")) * 100 + (key % 7) - 3).cast("decimal(18,4)").alias("pnl"),
        (F.col("n_lines") * 5).cast("decimal(18,4)").alias("max_loss"),
        (F.col("o_orderstatus") != "P").alias("was_traded"),
        (key % 11 == 0).alias("abstained"),
        (key % 13 == 0).alias("vetoed"),
        (F.col("o_orderstatus") == "F").alias("false_positive"),
        (F.col("max_qty") / 100.0).alias("brier"),
        F.when(key % 5 != 0, F.col("max_qty") / 50.0).alias("log_loss"),
        F.col("o_totalprice").alias("notional"),
    )


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as an event journal: one chain per conversation."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("chain"),
        (F.col("turn") + 1).alias("sequence_number"),
        F.col("role").alias("status"),
        F.col("text").alias("payload"),
    )


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """labels ⋈ documents as scored observations: y and a deterministic p of the text length."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    y = table(spark, sf, "labels")
    return y.join(d, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        "toxic",
        ((F.col("n_chars") % 997) / 997.0).alias("p"),
        F.col("source").alias("family"),
        "lang",
        "n_chars",
    )


# --------------------------------------------------------------------------------------------------------------
# The same views as SQL text. Each oracle starts with the views it names.

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_ticks": ((), """
        SELECT event_type AS symbol, ts, 100.0 + value / 10.0 AS price, 1 + user_id % 10 AS size, event_id AS seq
        FROM events"""),
    "v_bars30": (("v_ticks",), """
        SELECT symbol, session_date, session_date::TIMESTAMP + to_minutes((bucket * 30 + 570)::BIGINT) AS ts,
               first(price ORDER BY tick_ts, seq) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY tick_ts, seq) AS close, sum(size)::BIGINT AS volume
        FROM (SELECT symbol, ts AS tick_ts, seq, price, size, ts::DATE AS session_date,
                     floor((hour(ts) * 60 + minute(ts) - 570) / 30.0)::INT AS bucket FROM v_ticks)
        GROUP BY symbol, session_date, bucket"""),
    "v_bars60": (("v_ticks",), """
        SELECT symbol, session_date, session_date::TIMESTAMP + to_minutes((bucket * 60 + 570)::BIGINT) AS ts,
               first(price ORDER BY tick_ts, seq) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY tick_ts, seq) AS close, sum(size)::BIGINT AS volume
        FROM (SELECT symbol, ts AS tick_ts, seq, price, size, ts::DATE AS session_date,
                     floor((hour(ts) * 60 + minute(ts) - 570) / 60.0)::INT AS bucket FROM v_ticks)
        GROUP BY symbol, session_date, bucket"""),
    "v_tape15": ((), """
        SELECT session_date, session_date::TIMESTAMP + to_minutes((bucket * 15 + 570)::BIGINT) AS ts,
               first(price ORDER BY tick_ts, seq) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY tick_ts, seq) AS close, sum(size)::BIGINT AS volume
        FROM (SELECT ts AS tick_ts, event_id AS seq, 100.0 + value / 10.0 AS price, 1 + user_id % 10 AS size,
                     ts::DATE AS session_date, floor((hour(ts) * 60 + minute(ts) - 570) / 15.0)::INT AS bucket
              FROM events)
        GROUP BY session_date, bucket"""),
    "v_chain": ((), f"""
        SELECT snapshot_id, side, strike, 25.0 AS spot, l_orderkey * 8 + l_linenumber AS pos, gamma, delta,
               open_interest, volume, bid, ask, mark, last, iv
        FROM (SELECT {BLOCK_MONTH_SQL} AS snapshot_id,
                     CASE WHEN l_linenumber % 2 = 0 THEN 'put' ELSE 'call' END AS side, l_quantity AS strike,
                     l_orderkey, l_linenumber, l_discount AS gamma, l_tax * 10 - 0.4 AS delta,
                     trunc(l_extendedprice)::BIGINT AS open_interest, l_partkey % 500 AS volume,
                     l_extendedprice / 1000.0 AS bid, l_extendedprice / 1000.0 * (1.0 + l_tax) AS ask,
                     CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 990.0 END AS mark,
                     l_extendedprice / 1010.0 AS last, 0.1 + l_discount AS iv,
                     row_number() OVER (PARTITION BY {BLOCK_MONTH_SQL}, l_linenumber % 2, l_quantity
                                        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
              FROM lineitem)
        WHERE rn = 1"""),
    "v_options": ((), """
        SELECT snapshot_id, option_type, strike, option_type || '-' || strike::INT AS contract_id, 1000.0 AS spot,
               (cents / 100.0)::DECIMAL(18, 6) AS bid, ((cents + 1 + l_linenumber) / 100.0)::DECIMAL(18, 6) AS ask,
               ((2 * cents + 1 + l_linenumber) / 200.0)::DECIMAL(18, 6) AS mid, 0.1 + l_discount AS iv,
               (l_partkey % 8)::DOUBLE AS age_seconds
        FROM (SELECT strftime(l_shipdate, '%Y-%m') AS snapshot_id,
                     CASE WHEN l_linenumber % 2 = 0 THEN 'put' ELSE 'call' END AS option_type,
                     (l_quantity + 975)::DECIMAL(18, 6) AS strike, floor(l_extendedprice / 100)::BIGINT AS cents,
                     l_linenumber, l_discount, l_partkey,
                     row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m'), l_linenumber % 2, l_quantity
                                        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
              FROM lineitem)
        WHERE rn = 1"""),
    "v_quotes": ((), """
        SELECT strftime(l_shipdate, '%Y-%m') AS snapshot_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'put' ELSE 'call' END AS side, l_quantity AS strike, 25.0 AS spot,
               l_orderkey * 8 + l_linenumber AS pos, l_discount AS gamma,
               trunc(l_extendedprice)::BIGINT AS open_interest, l_partkey % 500 AS volume
        FROM lineitem"""),
    "v_feed": ((), """
        SELECT strftime(ts, '%Y-%m-%d %H') AS snapshot_id, event_type AS component, 'p' || (user_id % 3) AS provider,
               (user_id % 3)::INT AS attempt_order, ts AS received_at,
               CASE WHEN user_id % 17 <> 0 THEN value - 1.0 END AS age_seconds, 20.0 AS freshness_limit_seconds,
               user_id % 5 = 0 AS fallback_used, event_id AS seq
        FROM events"""),
    "v_trades": ((), """
        SELECT o_orderkey AS trade_id, o_orderdate::DATE AS session_date, o_custkey % 6 AS account_id,
               o_orderpriority AS family, 'v' || (o_orderkey % 3) AS variant,
               ((disc - tax) * 100 + o_orderkey % 7 - 3)::DECIMAL(18, 4) AS pnl,
               (n_lines * 5)::DECIMAL(18, 4) AS max_loss, o_orderstatus <> 'P' AS was_traded,
               o_orderkey % 11 = 0 AS abstained, o_orderkey % 13 = 0 AS vetoed, o_orderstatus = 'F' AS false_positive,
               max_qty / 100.0 AS brier, CASE WHEN o_orderkey % 5 <> 0 THEN max_qty / 50.0 END AS log_loss,
               o_totalprice AS notional
        FROM orders JOIN (SELECT l_orderkey, sum(l_discount::DECIMAL(12, 2)) AS disc,
                                 sum(l_tax::DECIMAL(12, 2)) AS tax, count(*) AS n_lines, max(l_quantity) AS max_qty
                          FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""),
    "v_journal": ((), """
        SELECT conv_id AS chain, turn + 1 AS sequence_number, role AS status, text AS payload FROM conversations"""),
    "v_probs": ((), """
        SELECT doc_id, quality AS y, toxic, (n_chars % 997) / 997.0 AS p, source AS family, lang, n_chars
        FROM labels JOIN documents USING (doc_id)"""),
}


def sql(body: str, *views: str) -> str:
    """Oracle text: the named views (with what they build on) as CTEs, then the body."""
    ordered: list[str] = []

    def need(view: str) -> None:
        for dep in SQL_VIEWS[view][0]:
            need(dep)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        need(view)
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v][1]})" for v in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        head = "WITH RECURSIVE" if body[5:15].upper() == "RECURSIVE " else "WITH"
        return f"{head} {ctes}, {body[15:] if head == 'WITH RECURSIVE' else body[5:]}"
    return f"WITH {ctes} {body}"
