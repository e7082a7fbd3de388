"""Summaries over signals, settlements, runs and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds as odds_fn


def alert_stats(bets: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Delivered alerts per model and in total (model null).

    ``bets``: model, decision, sent_at, created_at, odds, outcome, stake,
    profit; outcome is null while unsettled. Void counts as a return.
    """
    sent = bets.where((F.col("decision") == "alert") & F.col("sent_at").isNotNull())
    if since is not None:
        sent = sent.where(F.col("created_at") >= since)
    settled = F.col("outcome").isNotNull()
    stats = sent.rollup("model").agg(
        F.count("*").alias("signals"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        F.count_if(F.col("outcome") == "loss").alias("losses"),
        F.count_if(settled & ~F.col("outcome").isin("win", "loss")).alias("returns"),
        F.count_if(~settled).alias("pending"),
        F.sum(F.when(settled, F.col("stake"))).alias("total_stake"),
        F.sum(F.when(settled, F.col("profit"))).alias("profit"),
        F.avg(F.col("odds").cast("double")).alias("average_odds"),
    )
    roi = F.when(F.col("total_stake") > 0, F.col("profit") / F.col("total_stake") * 100)
    return stats.withColumn("roi_percent", roi)


def decision_summary(signals: DataFrame, *, reasons: int = 10) -> DataFrame:
    """Counts by decision and market and the most frequent skip reasons."""
    decisions = signals.groupBy(F.lit("decision").alias("kind"), F.col("decision").alias("label"))
    markets = signals.groupBy(F.lit("market").alias("kind"), F.col("market").alias("label"))
    skipped = signals.where("decision = 'skip'").select(F.explode("filter_reasons").alias("label"))
    top = (
        skipped.groupBy(F.lit("skip_reason").alias("kind"), "label")
        .count().orderBy(F.desc("count"), "label").limit(reasons)
    )
    return decisions.count().unionByName(markets.count()).unionByName(top)


def recent(df: DataFrame, order: Sequence[Column], limit: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def upcoming_signals(signals: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    ahead = signals.where((F.col("decision") == "alert") & (F.col("started_at") > now))
    return recent(ahead, [F.col("started_at"), F.col("signal_id")], limit)


def recent_results(settlements: DataFrame, limit: int = 10) -> DataFrame:
    return recent(settlements, [F.desc("settled_at"), F.desc("settlement_id")], limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest parser run of each source."""
    values = F.struct(*[name for name in runs.columns if name != "source"])
    return runs.groupBy("source").agg(
        F.max_by(values, F.struct("started_at", "run_id")).alias("r")
    ).select("source", "r.*")


def source_health(runs: DataFrame, now: Column, fresh_for: Column | float = 120.0) -> DataFrame:
    limit = F.lit(fresh_for) if isinstance(fresh_for, (int, float)) else fresh_for
    age = (F.unix_micros(now) - F.unix_micros("finished_at")) / 1e6
    newest = latest_runs(runs).withColumn("age_seconds", age)
    return newest.withColumn(
        "health", odds_fn.freshness(F.col("status"), F.col("age_seconds"), limit)
    )


def recent_errors(runs: DataFrame, limit: int = 10) -> DataFrame:
    bad = runs.where((F.col("status") == "error") | F.col("last_error").isNotNull())
    return recent(bad, [F.desc("started_at"), F.desc("run_id")], limit)


def system_status(signals: DataFrame) -> DataFrame:
    alert = F.col("decision") == "alert"
    return signals.agg(
        F.count("*").alias("predictions"),
        F.count_if(alert & F.col("sent_at").isNull()).alias("pending_alerts"),
        F.count_if(alert & F.col("sent_at").isNotNull()).alias("sent_alerts"),
        F.max(F.when(alert, F.col("created_at"))).alias("last_alert_created_at"),
        F.max("sent_at").alias("last_alert_sent_at"),
    )


def source_range(events: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    return events.groupBy(*by).agg(
        F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"),
        F.count("*").alias("events"),
    )


def with_participants(
    df: DataFrame, participants: DataFrame, *, event: str = "event_id", blank: Sequence[str] = ("P1", "P2")
) -> DataFrame:
    """Add both sides' names and teams to rows of events.

    ``participants``: event id, side, raw_name and optionally raw_team_name.
    Sides become columns once, so the report needs one left join, not two.
    """
    names = [name for name in ("raw_name", "raw_team_name") if name in participants.columns]
    sides = participants.groupBy(event).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{name}{side}")
            for side in (1, 2) for name in names
        ]
    )
    joined = df.join(sides, event, "left")
    return joined.withColumns(
        {f"raw_name{side}": F.coalesce(f"raw_name{side}", F.lit(blank[side - 1])) for side in (1, 2)}
    )
