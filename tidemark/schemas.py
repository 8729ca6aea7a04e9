"""Explicit schemas of recorded data. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


BAR = struct(timestamp=S, open=S, high=S, low=S, close=S, volume=L)
CONTRACT = struct(
    contract_id=S, underlying_symbol=S, expiration=S, option_type=S, strike=S, multiplier=I, settlement_style=S
)
QUOTE = struct(
    contract=CONTRACT, received_at=S, source=S, bid=S, ask=S, last=S, mark=S, volume=L, open_interest=L,
    implied_volatility=D, delta=D, gamma=D, theta=D, vega=D, observed_at=S, age_seconds=D, quality_flags=T.ArrayType(S),
)
FEED = struct(
    component=S, provider=S, received_at=S, status=S, freshness_limit_seconds=D, observed_at=S, age_seconds=D,
    attempt_order=I, fallback_used=B, error_code=S, error_message_hash=S,
)
SNAPSHOT = struct(
    snapshot_id=S, content_hash=S, schema_version=S, normalization_version=S, underlying_symbol=S, session_status=S,
    timestamp=S, session_date=S, underlying_price=S, underlying_bid=S, underlying_ask=S, minutes_from_open=I,
    minutes_to_close=I, bars_1m=T.ArrayType(BAR), option_chain=T.ArrayType(QUOTE), feed_observations=T.ArrayType(FEED),
    catalyst_state=struct(lockout_active=B, reason=S), data_quality=struct(is_healthy=B, penalty=D, flags=T.ArrayType(S)),
    missing_components=T.ArrayType(S),
    volatility_term_structure=struct(vix=D, vix9d=D, vix3m=D, vvix=D, vvix_baseline=D, source=S),
    breadth=struct(rsp_spy_div=D, sector_align=D, top10_pressure=D, sectors_observed=I, source=S),
)
RECORD = struct(seq=L, snapshot_id=S, schema_version=S, record_hash=S, snapshot=S)

OPTION_ROW = struct(side=S, strike=D, oi=D, gamma=D, bid=D, ask=D, delta=D, volume=D, dte_days=D)
VENDOR_LINE = struct(
    t=S, ts=S, date=S, price=D, market=T.MapType(S, S), option_rows=T.ArrayType(OPTION_ROW), bars=T.ArrayType(T.ArrayType(S))
)
LEGACY = struct(
    snapshot_id=S, schema_version=S, symbol=S, ts=S, session_date=S, market=T.MapType(S, S), spot=S,
    feed_statuses=T.MapType(S, S), source_ages_seconds=T.MapType(S, D), configuration_hash=S,
)
EXPERIENCE = struct(snapshot_id=S, session_date=S, packet=S, realized_pnl=D, labels=T.MapType(S, S), realized_pnl_by_candidate=T.MapType(S, D))
