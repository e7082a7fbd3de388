"""Strategy parameters as a small validated table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameter defaults and stake modes.
DEFAULTS: dict[str, Any] = {
    "prediction_enabled": False,
    "alerts_enabled": False,
    "source": None,
    "model_name": None,
    "model_version": None,
    "safety_multiplier": 1.0,
    "stake_mode": "fixed",
    "base_stake": 1.0,
    "max_stake": None,
    "initial_bankroll": 100.0,
    "min_samples": 0,
    "min_h2h": 0,
    "min_odds": 1.01,
    "max_odds": 100.0,
    "min_probability": 0.0,
    "max_probability": 1.0,
    "min_value_percent": 0.0,
    "min_match_confidence": 0.90,
    "stale_after_seconds": 120.0,
    "min_alert_lead_seconds": 15.0,
    "suspicious_edge_percent": 50.0,
    "corridor_required_for_alert": False,
    "corridor_min_samples": 20,
    "max_alerts_per_event": 1,
    "allowed_markets": [],
    "allowed_tournaments": [],
}
STAKE_MODES = ("fixed", "observed_ml", "kelly_0_1", "kelly_0_25")
SCHEMA = (
    "strategy string, prediction_enabled boolean, alerts_enabled boolean, source string, "
    "model_name string, model_version string, safety_multiplier double, stake_mode string, "
    "base_stake double, max_stake double, initial_bankroll double, min_samples int, min_h2h int, "
    "min_odds double, max_odds double, min_probability double, max_probability double, "
    "min_value_percent double, min_match_confidence double, stale_after_seconds double, "
    "min_alert_lead_seconds double, suspicious_edge_percent double, "
    "corridor_required_for_alert boolean, corridor_min_samples int, max_alerts_per_event int, "
    "allowed_markets array<string>, allowed_tournaments array<string>"
)


def problems() -> list[tuple[Any, str]]:
    """Conditions under which a row is rejected, each with its message."""
    c = F.col

    def outside(name: str) -> Any:
        return ~c(name).between(0, 1)

    return [
        (c("safety_multiplier") <= 0, "safety_multiplier must be positive"),
        (~c("stake_mode").isin(*STAKE_MODES), "unknown stake_mode"),
        ((c("base_stake") <= 0) | (c("max_stake") <= 0), "stakes must be positive"),
        (c("initial_bankroll") <= 0, "initial_bankroll must be positive"),
        ((c("min_samples") < 0) | (c("min_h2h") < 0), "sample limits must not be negative"),
        ((c("min_odds") <= 1) | (c("max_odds") <= 1), "odds limits must exceed one"),
        (c("min_odds") > c("max_odds"), "min_odds cannot exceed max_odds"),
        (outside("min_probability") | outside("max_probability"), "probability limits must be in [0, 1]"),
        (c("min_probability") > c("max_probability"), "min_probability cannot exceed max_probability"),
        (c("min_value_percent") < 0, "min_value_percent must not be negative"),
        (outside("min_match_confidence"), "min_match_confidence must be in [0, 1]"),
        (c("stale_after_seconds") <= 0, "stale_after_seconds must be positive"),
        (~c("min_alert_lead_seconds").between(0, 600), "min_alert_lead_seconds must be in [0, 600]"),
        (c("suspicious_edge_percent") <= 0, "suspicious_edge_percent must be positive"),
        (c("corridor_min_samples") <= 0, "corridor_min_samples must be positive"),
        (~c("max_alerts_per_event").between(1, 10), "max_alerts_per_event must be in [1, 10]"),
        (c("alerts_enabled") & ~c("prediction_enabled"), "alerts_enabled requires prediction_enabled"),
    ]


def invalid(table: DataFrame) -> DataFrame:
    """(strategy, problem) of every broken rule."""
    rules = F.array(*[F.when(bad, F.lit(text)) for bad, text in problems()])
    found = F.explode(F.filter(rules, lambda text: text.isNotNull()))
    return table.select("strategy", found.alias("problem"))


def strategies(spark: SparkSession, definitions: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Table of strategies; unknown names and out-of-range values raise.

    The table has one row per configured strategy, so checking it on the driver
    is a check of configuration and not of data.
    """
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]
    rows = []
    for strategy, given in definitions.items():
        unknown = set(given) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"{strategy}: unknown parameters {sorted(unknown)}")
        merged = {**DEFAULTS, **given, "strategy": strategy}
        rows.append(tuple(merged[name] for name in names))
    table = spark.createDataFrame(rows, SCHEMA)
    broken = invalid(table).take(1)
    if broken:
        raise ValueError(f"{broken[0]['strategy']}: {broken[0]['problem']}")
    return table
