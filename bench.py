"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "resample_ohlcv", "resample_all_timeframes", "adx_di", "bollinger", "keltner", "donchian", "realized_vol_rank", "gex_rank",
    "gex_levels", "flow", "atm_straddle", "rnd_summary", "spot_from_parity", "data_quality", "session_status", "asof_latest",
    "label_forward_returns", "label_wall_touches", "first_passage", "credit_verticals", "iron_condors", "candidate_economics",
    "managed_outcome", "candidate_training_set", "candidate_universe", "knn_distance", "ood_score", "train_group", "mtf_matrix", "streaming_gex_rank", "evaluate_trades", "decision_report", "attribute_trades", "shadow_account", "rank_snapshot", "policy_ensemble",
    "duplicate_decisions", "portfolio_state", "account_ledger", "inspect_recordings", "verify_hash_chain", "calibrate_regimes",
    "split_conformal", "ensemble_weights", "explode_chain", "streaming_bars",
)


def main() -> None:
    from tidemark.plans import QUERIES, load
    from tidemark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = local_session(cores, "bench", **{"spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.range(1000).selectExpr("sum(id)").collect()
    picks = sys.argv[1:] or HEADLINES
    took: dict[str, float] = {}
    for name in picks:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
