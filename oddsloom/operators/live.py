"""Live flow as batch transformations: predictions to signals, signals to settlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import clock, settlement
from oddsloom.functions import odds as odds_fn
from oddsloom.operators import alerts, asof, baselines, corridors, quotes, simulate
from oddsloom.session import materialize

RESULT_MODEL, TOTAL_MODEL = "individual_h2h_fixed", "poisson_goals"


def _probabilities(rows: DataFrame) -> DataFrame:
    """Model probability of each contract, turned to the book's sides."""
    results = baselines.baseline_probabilities(
        rows.where(F.col("market") == "1x2"), (), (RESULT_MODEL,)
    ).drop("model")
    home, away = settlement.orient(F.col("p1"), F.col("p2"), F.col("reversed_sides"))
    chance = F.when(F.col("selection") == "P1", home).when(
        F.col("selection") == "X", F.col("px")
    ).otherwise(away)
    results = results.withColumn("probability", chance).drop("p1", "px", "p2")
    totals = baselines.total_probabilities(rows.where(F.col("market") == "total"), ())
    totals = totals.withColumn("probability", F.col("total_conditional"))
    return results.unionByName(totals.select(*results.columns))


def candidates(
    quote_rows: DataFrame,
    matches: DataFrame,
    history: DataFrame,
    strategies: DataFrame,
    *,
    now: Column,
    predicted: DataFrame | None = None,
) -> DataFrame:
    """Opportunities of the newest quotes of matched future events.

    ``quote_rows``: book_event_id, snapshot_id, market, selection, line, odds,
    received_at. ``matches``: match_id, source_event_id, book_event_id,
    confidence, reversed_sides, started_at (book), status, source, sport, game,
    family, bookmaker, tournament and the source event's players and teams.
    Features look at the quote's own time, the decision is taken at ``now``.
    """
    open_events = matches.where((F.col("status") == "scheduled") & (F.col("started_at") > now))
    newest = quotes.newest(
        quotes.canonical(
            quote_rows.where(F.col("received_at") <= now).join(
                open_events.select("book_event_id"), "book_event_id", "left_semi"
            )
        ),
        ("book_event_id", "market", "selection", "line"),
    ).drop("raw_selection")
    wanted = strategies.where("prediction_enabled").withColumn("market", F.explode("allowed_markets"))
    rows = newest.join(open_events, "book_event_id").join(wanted, ["source", "market"])
    rows = rows.where(F.col("received_at") < F.col("started_at"))
    if predicted is not None:
        rows = rows.join(predicted, ["snapshot_id", "model_name", "model_version"], "left_anti")
    looks = rows.select(
        F.col("source_event_id").alias("event_id"), F.col("received_at").alias("cutoff_at"),
        "sport", "player1", "player2",
    ).distinct()
    form = asof.last_n_form(history, looks, scopes=baselines.FORM_SCOPES, windows=(), medians=False)
    cells = baselines.with_sample_sizes(baselines.form_by_event(form, ()), ())
    featured = rows.join(
        cells.withColumnsRenamed({"event_id": "source_event_id", "cutoff_at": "received_at"}),
        ["source_event_id", "received_at"],
    )
    priced = _probabilities(featured)
    return priced.withColumns(
        {
            "event_id": F.col("book_event_id"),
            "event_started_at": F.col("started_at"),
            "decision_at": now,
            "feature_cutoff_at": F.col("received_at"),
            "odds_received_at": F.col("received_at"),
            "odds_snapshot_id": F.col("snapshot_id"),
            "sample_size": F.least("player1_samples", "player2_samples"),
            "match_confidence": F.col("confidence").cast("double"),
        }
    )


def generate_signals(
    quote_rows: DataFrame,
    matches: DataFrame,
    history: DataFrame,
    strategies: DataFrame,
    corridor_table: DataFrame,
    *,
    now: Column,
    predicted: DataFrame | None = None,
    stored_keys: DataFrame | None = None,
) -> DataFrame:
    """Signals of one run: every candidate with its decision and all reasons.

    Idempotent: ids derive from snapshot, model and version; predicted
    snapshots and stored alert keys are excluded by anti-joins.
    """
    found = candidates(
        quote_rows, matches, history, strategies, now=now, predicted=predicted
    )
    decided = simulate.decide(found)
    decided = decided.withColumn(
        "prediction_id", F.xxhash64("strategy", "snapshot_id", "model_name", "model_version")
    )
    # Several steps below read the candidates; the features behind them are
    # computed once.
    decided = materialize(decided, "signal-candidates")
    probes = decided.withColumns(
        {"game_key": F.coalesce("game", F.lit("")), "cutoff_at": now}
    )
    looked = corridors.lookup(
        probes, corridors.with_verdict(corridor_table), probe_id="prediction_id",
        min_samples="corridor_min_samples",
    )
    missing = F.col("corridor_sample_size").isNull()
    required = F.col("corridor_required_for_alert")
    out = alerts.skip_if(looked, required & missing, "corridor_unavailable")
    out = alerts.skip_if(
        out, required & ~missing & (F.col("corridor_verdict") != "confirm"), "corridor_not_confirmed"
    )
    out = alerts.skip_if(out, ~F.col("alerts_enabled"), "alerts_disabled")
    out = out.withColumn(
        "expires_at",
        odds_fn.delivery_expiry(F.col("started_at"), F.col("received_at"), F.col("stale_after_seconds")),
    )
    lead = clock.seconds_between(F.col("expires_at"), now)
    out = alerts.skip_if(out, lead < F.col("min_alert_lead_seconds"), "insufficient_delivery_window")
    out = alerts.select_alerts(out, limit=F.col("max_alerts_per_event"))
    key = odds_fn.alert_key(
        F.col("strategy"), F.col("event_id"), F.col("market"), F.col("selection"), F.col("line")
    )
    out = out.withColumn("alert_key", F.when(F.col("decision") == "alert", key))
    if stored_keys is not None:
        out = alerts.drop_repeated(out, stored_keys)
    multiplier = F.when(F.col("stake_mode") == "fixed", F.lit(1.0)).when(
        F.col("stake_mode") == "observed_ml", odds_fn.observed_multiplier(F.col("value_ratio"))
    )
    return alerts.with_stakes(out.withColumn("bet_multiplier", multiplier))


def settle_signals(
    signals: DataFrame, results: DataFrame, settled: DataFrame | None, *, now: Column
) -> DataFrame:
    """Settlements of delivered alerts whose result is known and not yet booked.

    ``signals``: signal_id, decision, sent_at, source_event_id, market,
    selection, line, odds, display_odds, stake_amount, suggested_stake,
    frozen_reversed, recorded_reversed. A contract that no longer settles is
    void and returns its stake.
    """
    stake = F.coalesce(
        F.when(F.col("stake_amount") != 0, F.col("stake_amount")), F.col("suggested_stake")
    ).cast("decimal(14,2)")
    due = signals.where((F.col("decision") == "alert") & F.col("sent_at").isNotNull())
    if settled is not None:
        due = due.join(settled.select("signal_id"), "signal_id", "left_anti")
    due = due.withColumn("stake", stake).where(F.col("stake") > 0)
    scored = due.join(
        results.select(F.col("event_id").alias("source_event_id"), "score1", "score2"), "source_event_id"
    )
    flag = settlement.reversed_flag(F.col("frozen_reversed"), F.col("recorded_reversed"))
    s1, s2 = settlement.orient(F.col("score1"), F.col("score2"), flag)
    judged = settlement.with_outcome(scored.withColumns({"score1": s1, "score2": s2}))
    price = F.coalesce(F.when(F.col("display_odds") != 0, F.col("display_odds")), F.col("odds"))
    judged = judged.withColumns(
        {"outcome": F.coalesce("outcome", F.lit("void")), "price": price.cast("decimal(12,5)")}
    )
    paid = judged.withColumn(
        "payout", F.bround(settlement.payout(F.col("outcome"), F.col("stake"), F.col("price")), 2).cast("decimal(14,2)")
    )
    return paid.select(
        "signal_id", "outcome", "stake", "payout",
        (F.col("payout") - F.col("stake")).cast("decimal(14,2)").alias("profit"), now.alias("settled_at"),
    )
