"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Every query runs into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oddsloom.plans.catalog import QUERIES  # noqa: E402
from oddsloom.session import build_session  # noqa: E402

HEADLINE = (
    "asof_player_form",
    "asof_h2h_form",
    "session_features",
    "baseline_probabilities",
    "poisson_totals",
    "walk_forward_metrics",
    "calibration_bins",
    "implied_probability",
    "odds_movement",
    "closing_quotes",
    "settled_quotes",
    "corridors",
    "corridor_lookup",
    "signal_filter_reasons",
    "bankroll_path",
    "drawdown_streaks",
    "market_backtest",
    "event_matching",
    "best_alert_per_event",
    "name_resolution",
    "json_ingest",
    "payload_dedup",
    "audit_orphans",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["closing_quotes"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in names:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
