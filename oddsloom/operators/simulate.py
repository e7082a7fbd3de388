"""Betting simulation: filters with reasons, staking, settlement, run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds as odds_fn
from oddsloom.functions import settlement
from oddsloom.operators import prefix

RUN = ("strategy",)
ORDER = ("decision_at", "event_id", "odds_snapshot_id")


def _chosen(reasons: Sequence[tuple[Column, str]]) -> Column:
    """Labels whose condition holds, in the given order."""
    flags = F.array(*[F.when(condition, F.lit(label)) for condition, label in reasons])
    return F.filter(flags, lambda label: label.isNotNull())


def _not_in(value: Column, allowed: Column) -> Column:
    return F.coalesce(F.size(allowed) > 0, F.lit(False)) & ~F.array_contains(allowed, value)


def with_value(df: DataFrame) -> DataFrame:
    """Add fair_odds, value_ratio, value_percent and minimum_odds."""
    p, price = F.col("probability"), F.col("odds")
    return df.withColumns(
        {
            "fair_odds": odds_fn.fair_odds(p),
            "value_ratio": odds_fn.value_ratio(p, price),
            "value_percent": odds_fn.value_percent(p, price),
            "minimum_odds": odds_fn.minimum_odds(p, F.col("safety_multiplier")),
        }
    )


def quote_age(df_decision: str = "decision_at", received: str = "odds_received_at") -> Column:
    return (F.unix_micros(df_decision) - F.unix_micros(received)) / 1e6


def filter_reasons() -> Column:
    """Every reason against a bet, in the fixed order of the checks."""
    price = F.col("odds").cast("double")
    p = F.col("probability")
    return _chosen(
        [
            (F.col("sample_size") < F.col("min_samples"), "insufficient_sample"),
            (F.col("h2h_samples") < F.col("min_h2h"), "insufficient_h2h"),
            (~price.between(F.col("min_odds"), F.col("max_odds")), "odds_out_of_range"),
            (~p.between(F.col("min_probability"), F.col("max_probability")), "probability_out_of_range"),
            (F.col("value_percent") < F.col("min_value_percent"), "below_minimum_value"),
            (_not_in(F.col("market"), F.col("allowed_markets")), "market_not_allowed"),
            (_not_in(F.col("tournament"), F.col("allowed_tournaments")), "tournament_not_allowed"),
            (F.col("match_confidence") < F.col("min_match_confidence"), "event_match_confidence"),
            (quote_age() > F.col("stale_after_seconds"), "stale_odds"),
            (F.col("value_percent") > F.col("suspicious_edge_percent"), "suspiciously_high_edge"),
            (price < F.col("minimum_odds"), "below_minimum_odds"),
        ]
    )


def anomaly_flags() -> Column:
    return _chosen(
        [
            (F.col("match_confidence") < F.col("min_match_confidence"), "incorrect_event_mapping"),
            (quote_age() > F.col("stale_after_seconds"), "stale_odds"),
            (F.col("value_percent") > F.col("suspicious_edge_percent"), "suspiciously_high_edge"),
        ]
    )


def clock_violation() -> Column:
    """Reason a row breaks the order of clocks; null for a sound row."""
    return (
        F.when(F.col("feature_cutoff_at") > F.col("decision_at"), "features look past the decision")
        .when(F.col("odds_received_at") > F.col("decision_at"), "quote came after the decision")
        .when(F.col("decision_at") > F.col("event_started_at"), "decision falls after kickoff")
    )


def temporal_violations(df: DataFrame) -> DataFrame:
    marked = df.withColumn("violation", clock_violation())
    return marked.where(F.col("violation").isNotNull())


def require_order(df: DataFrame) -> DataFrame:
    """Fail the job on the first row that breaks the order of clocks."""
    bad = clock_violation()
    return df.withColumn(
        "decision_at",
        F.when(bad.isNotNull(), F.raise_error(bad).cast("timestamp")).otherwise(F.col("decision_at")),
    )


def decide(df: DataFrame) -> DataFrame:
    """Reasons, flags, unit stake and decision of each opportunity.

    A bankroll stake is positive exactly when its Kelly fraction is, so the
    decision never depends on earlier bets.
    """
    valued = with_value(df)
    share = odds_fn.kelly_share(F.col("stake_mode"))
    kelly = odds_fn.kelly_fraction(F.col("probability"), F.col("odds"))
    unit = odds_fn.unit_stake(F.col("stake_mode"), F.col("base_stake"), F.col("value_ratio"))
    staged = valued.withColumns(
        {
            "reasons": filter_reasons(),
            "anomaly_flags": anomaly_flags(),
            "kelly": share * kelly,
            "unit_stake": unit,
        }
    )
    no_stake = (F.size("reasons") == 0) & (F.coalesce("unit_stake", "kelly") <= 0)
    reasons = F.when(
        no_stake, F.array_append("reasons", F.lit("zero_stake"))
    ).otherwise(F.col("reasons"))
    return staged.withColumn("filter_reasons", reasons).drop("reasons").withColumn(
        "decision", F.when(F.size("filter_reasons") == 0, "alert").otherwise("skip")
    )


def _with_results(df: DataFrame) -> DataFrame:
    """Decision, outcome and return per staked unit of each opportunity."""
    decided = settlement.with_outcome(decide(df)).withColumn(
        "outcome", F.when(F.col("decision") == "alert", F.col("outcome"))
    )
    price = F.col("odds").cast("double")
    return decided.withColumn(
        "unit_return",
        F.when(F.col("outcome") == "win", price - 1.0)
        .when(F.col("outcome") == "loss", F.lit(-1.0))
        .when(F.col("outcome") == "return", F.lit(0.0)),
    )


def _finish(df: DataFrame) -> DataFrame:
    gain = F.col("stake") * F.col("unit_return")
    return df.withColumns(
        {
            "bet_multiplier": F.when(
                F.col("decision") == "alert",
                F.when(F.col("stake_mode") == "fixed", F.lit(1.0))
                .when(
                    F.col("stake_mode") == "observed_ml",
                    odds_fn.observed_multiplier(F.col("value_ratio")),
                )
                .otherwise(F.col("stake") / F.col("base_stake")),
            ),
            "profit": gain,
            "payout": F.col("stake") + gain,
        }
    ).drop("kelly", "unit_stake", "unit_return")


def simulate(
    df: DataFrame, *, run: Sequence[str] = RUN, bucket_seconds: int = prefix.BUCKET_SECONDS
) -> DataFrame:
    """Decisions of ordered opportunities with the bankroll each one saw.

    Bets are ordered by (decision_at, event_id); a result moves the bankroll at
    once, even when a later decision precedes the end of that event. Adds
    stake, bet_multiplier, outcome, payout, profit and bankroll_before.

    Unit stakes add up and uncapped Kelly multiplies, so both are running sums.
    Capped Kelly is neither: each stake depends on the exact bankroll before
    it. Such rows fail. The input is read twice, once for the bucket totals.
    """
    capped = F.col("kelly").isNotNull() & F.col("max_stake").isNotNull()
    refuse = F.raise_error(F.lit("Kelly stakes with a limit cannot be simulated")).cast("string")
    staged = _with_results(df)
    staged = staged.withColumn("decision", F.when(capped, refuse).otherwise(F.col("decision")))
    alert = F.col("decision") == "alert"
    gain = F.when(alert, F.coalesce(F.col("unit_return"), F.lit(0.0))).otherwise(0.0)
    grows = F.col("kelly").isNotNull()
    walked = prefix.running_sums(
        staged,
        run=run, order=ORDER, at="decision_at", bucket_seconds=bucket_seconds,
        values={
            "_won": F.coalesce(F.col("unit_stake"), F.lit(0.0)) * gain,
            "_grown": F.when(grows, F.log(1.0 + F.col("kelly") * gain)).otherwise(0.0),
        },
    )
    bankroll = F.when(grows, F.col("initial_bankroll") * F.exp("_grown")).otherwise(
        F.col("initial_bankroll") + F.col("_won")
    )
    stake = F.coalesce(F.col("unit_stake"), F.col("bankroll_before") * F.col("kelly"))
    sized = walked.withColumn("bankroll_before", F.when(alert, bankroll)).withColumn(
        "stake", F.when(alert, stake)
    )
    return _finish(sized.drop("_won", "_grown"))


def run_metrics(
    decisions: DataFrame, *, run: Sequence[str] = RUN, bucket_seconds: int = prefix.BUCKET_SECONDS
) -> DataFrame:
    """Counts, profit, drawdown, streak and binary scores of each run.

    One shuffle by (run, time bucket); everything else merges bucket rows.
    """
    alert = F.col("decision") == "alert"
    done = alert & F.col("outcome").isNotNull()
    p = F.col("probability")
    won, lost = done & (F.col("outcome") == "win"), done & (F.col("outcome") == "loss")
    hit = F.when(won, 1.0).otherwise(0.0)
    low, high = F.lit(1e-15), F.lit(1 - 1e-15)
    loss = -(
        hit * F.log(F.least(high, F.greatest(low, p)))
        + (1.0 - hit) * F.log(F.least(high, F.greatest(low, 1.0 - p)))
    )

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))

    parts = {
        "predictions": F.count("*"),
        "bets": F.count_if(alert),
        "wins": F.count_if(won),
        "losses": F.count_if(lost),
        "returns": F.count_if(done & (F.col("outcome") == "return")),
        "unsettled": F.count_if(alert & F.col("outcome").isNull()),
        "total_stake": total(done, F.col("stake")),
        "profit": total(done, F.col("profit")),
        "odds_sum": total(alert, F.col("odds").cast("double")),
        "brier_sum": total(won | lost, F.pow(p - hit, F.lit(2.0))),
        "loss_sum": total(won | lost, loss),
    }
    summary = prefix.path_summary(
        decisions, run=run, order=ORDER, at="decision_at", bucket_seconds=bucket_seconds,
        profit=F.when(done, F.col("profit")).otherwise(0.0), won=won, lost=lost,
        extra=[value.alias(name) for name, value in parts.items()],
    )
    merged = prefix.merge_paths(
        summary, run=run, extra=[F.sum(name).alias(name) for name in parts]
    )
    decided = F.col("wins") + F.col("losses")
    roi = F.when(F.col("total_stake") > 0, 100.0 * F.col("profit") / F.col("total_stake")).otherwise(0.0)
    return merged.withColumns(
        {
            "average_odds": F.when(F.col("bets") > 0, F.col("odds_sum") / F.col("bets")).otherwise(0.0),
            "brier_score": F.when(decided > 0, F.col("brier_sum") / decided),
            "log_loss": F.when(decided > 0, F.col("loss_sum") / decided),
            "hit_rate_percent": F.when(decided > 0, 100.0 * F.col("wins") / decided).otherwise(0.0),
            "roi_percent": roi,
            "yield_percent": roi,
        }
    ).drop("odds_sum", "brier_sum", "loss_sum")


def market_results(bets: DataFrame) -> DataFrame:
    """One-unit results per market, per side of totals and per side and line."""
    line = odds_fn.line_text(F.col("line"))
    side = F.concat(F.lit("total_"), F.col("selection"))
    keys = F.when(F.col("market") == "1x2", F.array(F.col("market"))).otherwise(
        F.array(side, F.concat_ws("_", side, line))
    )
    rows = bets.select(F.explode(keys).alias("key"), "outcome", "odds").withColumn(
        "profit", settlement.unit_profit(F.col("outcome"), F.col("odds"))
    )
    grouped = rows.groupBy("key").agg(
        F.count("*").alias("bets"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        F.count_if(F.col("outcome") == "loss").alias("losses"),
        F.count_if(F.col("outcome") == "return").alias("returns"),
        F.sum("profit").cast("double").alias("profit"),
    )
    decided = F.col("wins") + F.col("losses")
    return grouped.withColumns(
        {
            "hit_rate_percent": F.when(decided > 0, 100.0 * F.col("wins") / decided).otherwise(0.0),
            "total_stake": F.col("bets").cast("double"),
            "roi_percent": 100.0 * F.col("profit") / F.col("bets"),
            "yield_percent": 100.0 * F.col("profit") / F.col("bets"),
        }
    )
