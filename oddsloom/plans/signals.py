"""Queries on alerts, settlements and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import clock, settlement
from oddsloom.operators import alerts, live, reports
from oddsloom.plans import bindings
from oddsloom.plans.form import rounded
from oddsloom.plans.pricing import CANONICAL
from oddsloom.plans.registry import query
from oddsloom.plans.corridor import METRICS
from oddsloom.sources.strategies import strategies

NOW = "2024-01-15 12:00:00"

SIGNALS = f"""{bindings.with_views('quotes')}, {CANONICAL},
sig AS (SELECT snapshot_id AS signal_id, 's' || (snapshot_id % 2) AS strategy, contract_event AS event_id, market, side AS selection, line, odds,
  CAST(snapshot_id * 7919 % 1000 AS DOUBLE) AS value_percent, CAST(snapshot_id % 13 AS DOUBLE) AS probability, CASE WHEN snapshot_id % 5 = 0 THEN 'skip' ELSE 'alert' END AS decision,
  CASE WHEN snapshot_id % 5 = 0 THEN ['stale_odds', 'r' || (snapshot_id % 17)] ELSE CAST([] AS VARCHAR[]) END AS reasons,
  received_at AS created_at, CASE WHEN snapshot_id % 3 = 0 THEN received_at + INTERVAL 30 SECOND END AS sent_at,
  CASE WHEN snapshot_id % 7 <> 0 THEN received_at + INTERVAL 3 HOUR END AS expires_at, kickoff AS started_at, score1, score2 FROM canon)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per quote: part skipped, part delivered, part with an expiry."""
    quotes = settlement.canonicalize(bindings.quotes(spark, sf_dir))
    snapshot, received = F.col("snapshot_id"), F.col("received_at")
    return quotes.select(
        snapshot.alias("signal_id"),
        F.concat(F.lit("s"), (snapshot % 2).cast("string")).alias("strategy"),
        F.col("contract_event").alias("event_id"), "market", "selection", "line", "odds",
        (snapshot * 7919 % 1000).cast("double").alias("value_percent"),
        (snapshot % 13).cast("double").alias("probability"),
        F.when(snapshot % 5 == 0, "skip").otherwise("alert").alias("decision"),
        F.when(
            snapshot % 5 == 0,
            F.array(F.lit("stale_odds"), F.concat(F.lit("r"), (snapshot % 17).cast("string"))),
        ).otherwise(F.array().cast("array<string>")).alias("filter_reasons"),
        F.lit(None).cast("string").alias("alert_key"),
        received.alias("created_at"),
        F.when(snapshot % 3 == 0, received + F.expr("INTERVAL 30 SECONDS")).alias("sent_at"),
        F.when(snapshot % 7 != 0, received + F.expr("INTERVAL 3 HOURS")).alias("expires_at"),
        F.col("kickoff").alias("started_at"), "score1", "score2",
    )


@query("best_alert_per_event", f"""{SIGNALS},
m AS (SELECT *, row_number() OVER (PARTITION BY strategy, event_id, market ORDER BY value_percent DESC, probability DESC, signal_id) AS a FROM sig WHERE decision = 'alert'),
e AS (SELECT *, row_number() OVER (PARTITION BY strategy, event_id ORDER BY value_percent DESC, probability DESC, signal_id) AS b FROM m WHERE a = 1)
SELECT s.signal_id, CASE WHEN e.b <= 1 THEN 'alert' ELSE 'skip' END AS decision,
  array_to_string(CASE WHEN s.decision = 'alert' AND (e.b IS NULL OR e.b > 1) THEN list_append(s.reasons, 'better_selection_available') ELSE s.reasons END, ',') AS filter_reasons
FROM sig s LEFT JOIN e ON e.signal_id = s.signal_id""")
def best_alert_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = alerts.select_alerts(signals(spark, sf_dir), row_id="signal_id")
    return chosen.select("signal_id", "decision", F.array_join("filter_reasons", ",").alias("filter_reasons"))


@query("alert_dedup", f"""{SIGNALS},
r AS (SELECT *, row_number() OVER (PARTITION BY strategy, event_id, selection ORDER BY CASE WHEN sent_at IS NOT NULL THEN 0 ELSE 1 END, coalesce(sent_at, created_at), signal_id) AS rn
  FROM sig WHERE decision = 'alert')
SELECT s.signal_id, CASE WHEN r.rn = 1 THEN 'alert' ELSE 'skip' END AS decision, CASE WHEN r.rn = 1 THEN s.strategy || ':' || s.event_id || ':' || s.selection END AS alert_key
FROM sig s LEFT JOIN r USING (signal_id)""")
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.demote_duplicates(signals(spark, sf_dir)).select("signal_id", "decision", "alert_key")


@query("one_alert_per_event", f"""{SIGNALS},
r AS (SELECT *, row_number() OVER (PARTITION BY strategy, event_id ORDER BY CASE WHEN sent_at IS NOT NULL THEN 0 ELSE 1 END,
    CASE WHEN sent_at IS NULL THEN value_percent END DESC NULLS LAST, coalesce(sent_at, created_at), signal_id) AS rn FROM sig WHERE decision = 'alert')
SELECT s.signal_id, CASE WHEN r.rn = 1 OR (r.rn > 1 AND s.sent_at IS NOT NULL) THEN 'alert' ELSE 'skip' END AS decision,
  CASE WHEN r.rn = 1 THEN s.strategy || ':' || s.event_id END AS alert_key FROM sig s LEFT JOIN r USING (signal_id)""")
def one_alert_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.one_alert_per_event(signals(spark, sf_dir)).select("signal_id", "decision", "alert_key")


@query("repeated_alerts", f"""{SIGNALS},
k AS (SELECT *, strategy || ':' || event_id || ':' || market AS key FROM sig WHERE decision = 'alert'),
j AS (SELECT signal_id, key, min(signal_id) OVER (PARTITION BY key) AS first, key IN (SELECT key FROM k WHERE created_at < TIMESTAMP '{NOW}') AS held FROM k WHERE created_at >= TIMESTAMP '{NOW}')
SELECT signal_id, CASE WHEN held OR first <> signal_id THEN 'skip' ELSE 'alert' END AS decision FROM j""")
def repeated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch against the keys an earlier one stored."""
    key = F.concat_ws(":", "strategy", F.col("event_id").cast("string"), "market")
    keyed = signals(spark, sf_dir).where("decision = 'alert'").withColumn("alert_key", key)
    now = F.lit(NOW).cast("timestamp")
    out = alerts.drop_repeated(
        keyed.where(F.col("created_at") >= now), keyed.where(F.col("created_at") < now), row_id="signal_id"
    )
    return out.select("signal_id", "decision")


@query("expired_alerts", f"""{SIGNALS}
SELECT signal_id, CASE WHEN decision = 'alert' AND sent_at IS NULL AND (started_at <= TIMESTAMP '{NOW}' OR coalesce(expires_at <= TIMESTAMP '{NOW}', FALSE)) THEN 'skip' ELSE decision END AS decision,
  array_to_string(CASE WHEN decision = 'alert' AND sent_at IS NULL AND (started_at <= TIMESTAMP '{NOW}' OR coalesce(expires_at <= TIMESTAMP '{NOW}', FALSE)) THEN list_append(reasons, 'delivery_expired') ELSE reasons END, ',') AS filter_reasons
FROM sig""")
def expired_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alerts.expire(signals(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select("signal_id", "decision", F.array_join("filter_reasons", ",").alias("filter_reasons"))


@query("pending_alerts", f"""{SIGNALS}
SELECT signal_id, event_id, selection FROM sig WHERE decision = 'alert' AND sent_at IS NULL AND started_at > TIMESTAMP '{NOW}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')
  AND started_at <= TIMESTAMP '{NOW}' + INTERVAL 2880 MINUTE ORDER BY started_at, signal_id LIMIT 50""")
def pending_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = alerts.pending(signals(spark, sf_dir), F.lit(NOW).cast("timestamp"), window_minutes=2880)
    return waiting.select("signal_id", "event_id", "selection")


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with settlements of those whose event is over."""
    over = F.col("started_at") <= F.lit("2024-01-25").cast("timestamp")
    settled = settlement.with_outcome(signals(spark, sf_dir).withColumnRenamed("strategy", "model"))
    return settled.withColumn("outcome", F.when(over, F.col("outcome"))).withColumns(
        {
            "stake": F.when(over, F.lit(1).cast("decimal(14,2)")),
            "profit": F.when(over, settlement.unit_profit(F.col("outcome"), F.col("odds"))),
        }
    )


_BOOKED = f"""{SIGNALS},
booked AS (SELECT *, CASE WHEN started_at <= TIMESTAMP '2024-01-25' THEN CASE
    WHEN selection = 'P1' THEN CASE WHEN score1 > score2 THEN 'win' ELSE 'loss' END
    WHEN selection = 'P2' THEN CASE WHEN score2 > score1 THEN 'win' ELSE 'loss' END
    WHEN selection = 'X' THEN CASE WHEN score1 = score2 THEN 'win' ELSE 'loss' END
    WHEN score1 + score2 = line THEN 'return'
    WHEN (score1 + score2 > line) = (selection = 'over') THEN 'win' ELSE 'loss' END END AS outcome FROM sig)"""


@query("alert_stats", f"""{_BOOKED},
s AS (SELECT strategy AS model, count(*) AS signals, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses,
    count(*) FILTER (WHERE outcome = 'return') AS returns, count(*) FILTER (WHERE outcome IS NULL) AS pending, CAST(count(outcome) AS DOUBLE) AS total_stake,
    CAST(sum(CASE outcome WHEN 'win' THEN odds - 1 WHEN 'loss' THEN -1 WHEN 'return' THEN 0 END) AS DOUBLE) AS profit, avg(CAST(odds AS DOUBLE)) AS average_odds
  FROM booked WHERE decision = 'alert' AND sent_at IS NOT NULL AND created_at >= TIMESTAMP '2024-01-05' GROUP BY ROLLUP (strategy))
SELECT model, signals, wins, losses, returns, pending, total_stake, round(profit, 5) AS profit, round(average_odds, 6) AS average_odds, round(profit / total_stake * 100, 6) AS roi_percent FROM s""")
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.alert_stats(booked(spark, sf_dir), since=F.lit("2024-01-05").cast("timestamp"))
    shaped = stats.withColumns({name: F.col(name).cast("double") for name in ("total_stake", "profit")})
    return rounded(
        shaped.withColumn("roi_percent", F.col("profit") / F.col("total_stake") * 100)
        .withColumn("profit", F.round("profit", 5))
    )


@query("decision_summary", f"""{SIGNALS}
SELECT 'decision' AS kind, decision AS label, count(*) AS count FROM sig GROUP BY decision
UNION ALL SELECT 'market', market, count(*) FROM sig GROUP BY market
UNION ALL (SELECT 'skip_reason', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM sig WHERE decision = 'skip') GROUP BY reason ORDER BY count(*) DESC, reason LIMIT 10)""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.decision_summary(signals(spark, sf_dir))


@query("upcoming_signals", f"""{SIGNALS}
SELECT signal_id, strategy, selection FROM sig WHERE decision = 'alert' AND started_at > TIMESTAMP '{NOW}' ORDER BY started_at, signal_id LIMIT 10""")
def upcoming_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = reports.upcoming_signals(signals(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return ahead.select("signal_id", "strategy", "selection")


@query("recent_results", f"""{_BOOKED}
SELECT signal_id AS settlement_id, outcome FROM booked WHERE outcome IS NOT NULL ORDER BY started_at DESC, signal_id DESC LIMIT 10""")
def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = booked(spark, sf_dir).where("outcome IS NOT NULL").select(
        F.col("signal_id").alias("settlement_id"), F.col("started_at").alias("settled_at"), "outcome"
    )
    return reports.recent_results(done).select("settlement_id", "outcome")


@query("system_status", f"""{SIGNALS}
SELECT count(*) AS predictions, count(*) FILTER (WHERE decision = 'alert' AND sent_at IS NULL) AS pending_alerts, count(*) FILTER (WHERE decision = 'alert' AND sent_at IS NOT NULL) AS sent_alerts,
  epoch_us(max(created_at) FILTER (WHERE decision = 'alert')) AS last_alert_created_us, epoch_us(max(sent_at)) AS last_alert_sent_us FROM sig""")
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = reports.system_status(signals(spark, sf_dir))
    return status.select(
        "predictions", "pending_alerts", "sent_alerts",
        F.unix_micros("last_alert_created_at").alias("last_alert_created_us"),
        F.unix_micros("last_alert_sent_at").alias("last_alert_sent_us"),
    )


def parser_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser run per event row, one source per event type."""
    events = bindings.table(spark, sf_dir, "events")
    event = F.col("event_id")
    return events.select(
        F.col("event_type").alias("source"), event.alias("run_id"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_interval(secs=event % 90)).alias("finished_at"),
        F.when(event % 3 == 0, "partial").when(event % 7 == 0, "error").otherwise("success").alias("status"),
        F.when(event % 11 == 0, F.lit("boom")).alias("last_error"),
    )


_RUNS = """runs AS (SELECT event_type AS source, event_id AS run_id, ts AS started_at, ts + to_seconds(event_id % 90) AS finished_at,
  CASE WHEN event_id % 3 = 0 THEN 'partial' WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 11 = 0 THEN 'boom' END AS last_error FROM events)"""


@query("source_health", f"""WITH {_RUNS}, last AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS rn FROM runs)
SELECT source, run_id, status, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(finished_at)) / 1e6, 6) AS age_seconds,
  CASE WHEN status = 'success' AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(finished_at)) / 1e6 <= 3000 THEN 'ok' WHEN status IN ('success', 'partial') THEN 'warn' ELSE 'error' END AS health
FROM last WHERE rn = 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = reports.source_health(parser_runs(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), 3000.0)
    return rounded(health.select("source", "run_id", "status", "age_seconds", "health"))


@query("recent_errors", f"""WITH {_RUNS} SELECT source, run_id, status FROM runs WHERE status = 'error' OR last_error IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 10""")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_errors(parser_runs(spark, sf_dir)).select("source", "run_id", "status")


@query("source_ranges", f"""{bindings.with_views('matches')}
SELECT source, epoch_us(min(started_at)) AS first_us, epoch_us(max(started_at)) AS last_us, count(*) AS events FROM matches GROUP BY source""")
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = reports.source_range(bindings.matches(spark, sf_dir))
    return ranges.select(
        "source", F.unix_micros("first_start").alias("first_us"), F.unix_micros("last_start").alias("last_us"), "events"
    )


@query("today_boundary", """SELECT event_id, epoch_us(date_trunc('day', ts + INTERVAL 3 HOUR)::TIMESTAMP - INTERVAL 3 HOUR) AS midnight_us FROM events""")
def today_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of the local day an event falls into."""
    events = bindings.table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.unix_micros(clock.local_midnight(F.col("ts"), "Europe/Moscow")).alias("midnight_us")
    )


@query("settled_signals", f"""{SIGNALS},
due AS (SELECT *, CASE WHEN signal_id % 8 = 0 THEN 0 ELSE 10 + signal_id % 90 END::DECIMAL(14,2) AS stake, CASE WHEN signal_id % 6 = 0 THEN score2 ELSE score1 END AS a, CASE WHEN signal_id % 6 = 0 THEN score1 ELSE score2 END AS b
  FROM sig WHERE decision = 'alert' AND sent_at IS NOT NULL AND signal_id % 10 <> 0),
won AS (SELECT *, CASE WHEN signal_id % 9 = 0 THEN 'void' WHEN selection = 'P1' THEN CASE WHEN a > b THEN 'win' ELSE 'loss' END WHEN selection = 'P2' THEN CASE WHEN b > a THEN 'win' ELSE 'loss' END
    WHEN selection = 'X' THEN CASE WHEN a = b THEN 'win' ELSE 'loss' END WHEN a + b = line THEN 'return' WHEN (a + b > line) = (selection = 'over') THEN 'win' ELSE 'loss' END AS outcome FROM due WHERE stake > 0),
paid AS (SELECT *, round_even(CASE outcome WHEN 'win' THEN stake * odds WHEN 'loss' THEN 0 ELSE stake END::DECIMAL(18,7), 2) AS payout FROM won)
SELECT signal_id, outcome, CAST(stake AS DOUBLE) AS stake, CAST(payout AS DOUBLE) AS payout, CAST(payout - stake AS DOUBLE) AS profit FROM paid""")
def settled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered alerts settled once; contracts that no longer settle are void."""
    signal = F.col("signal_id")
    rows = signals(spark, sf_dir).withColumns(
        {
            "source_event_id": signal,
            "market": F.when(signal % 9 == 0, "corners").otherwise(F.col("market")),
            "display_odds": F.when(signal % 2 == 0, F.col("odds")),
            "stake_amount": F.when(signal % 8 == 0, F.lit(0)).otherwise(10 + signal % 90).cast("decimal(14,2)"),
            "suggested_stake": F.lit(0).cast("decimal(14,2)"),
            "frozen_reversed": F.when(signal % 6 == 0, F.lit(True)),
            "recorded_reversed": signal % 6 == 0,
        }
    )
    results = rows.select(signal.alias("event_id"), "score1", "score2")
    stored = rows.where(signal % 10 == 0).select("signal_id")
    booked_rows = live.settle_signals(
        rows.drop("score1", "score2"), results, stored, now=F.lit(NOW).cast("timestamp")
    )
    return booked_rows.select(
        "signal_id", "outcome", *[F.col(name).cast("double").alias(name) for name in ("stake", "payout", "profit")]
    )


LIVE = {
    "results": {"source": "any", "model_name": live.RESULT_MODEL, "model_version": "v1", "safety_multiplier": 1.05,
                "min_samples": 5, "min_odds": 1.2, "max_odds": 10.0, "stale_after_seconds": 21600.0, "allowed_markets": ["1x2"],
                "prediction_enabled": True, "alerts_enabled": True, "suspicious_edge_percent": 500.0,
                "corridor_required_for_alert": True, "corridor_min_samples": 30, "max_alerts_per_event": 1},
    "totals": {"source": "any", "model_name": live.TOTAL_MODEL, "model_version": "v1", "safety_multiplier": 1.0,
               "min_samples": 5, "stale_after_seconds": 43200.0, "allowed_markets": ["total"], "prediction_enabled": True,
               "alerts_enabled": True, "suspicious_edge_percent": 500.0, "max_alerts_per_event": 2},
}


def live_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Quotes, a match table, history and a corridor table for the live run.

    Each quoted event is matched with the first history event of its quotes.
    """
    quotes = bindings.quotes(spark, sf_dir).withColumn("book_event_id", F.col("contract_event"))
    history = bindings.matches(spark, sf_dir)
    pairs = quotes.groupBy("book_event_id").agg(
        F.min("snapshot_id").alias("source_event_id"), F.min("kickoff").alias("started_at")
    )
    event = F.col("book_event_id")
    own = history.select(F.col("event_id").alias("source_event_id"), "sport", "player1", "player2")
    matches = pairs.join(own, "source_event_id").withColumns(
        {
            "match_id": event, "confidence": F.lit(0.95) - (event % 5) / 100.0, "reversed_sides": event % 3 == 0,
            "status": F.lit("scheduled"), "source": F.lit("any"), "game": F.lit(None).cast("string"),
            "family": F.lit(None).cast("string"), "bookmaker": F.lit("book"), "tournament": F.lit("T"),
        }
    )
    bets = bindings.bets(spark, sf_dir).select(
        F.lit("book").alias("bookmaker"), F.lit("football").alias("sport"), F.lit("").alias("game_key"),
        F.lit("1x2").alias("market"),
        F.when(F.col("market") == "O", "P1").otherwise("X").alias("selection"),
        F.lit(None).cast("decimal(10,3)").alias("line"), F.lit("").alias("family"), "odds", "outcome",
    )
    return {"quotes": quotes.drop("contract_event"), "matches": matches, "history": history, "bets": bets}


_LIVE_SQL = f"""{bindings.with_views('quotes', 'matches', 'bets')}, {CANONICAL},
pairs AS (SELECT contract_event, min(snapshot_id) AS source_event_id, min(kickoff) AS started_at FROM canon GROUP BY contract_event),
em AS (SELECT p.*, m.sport, m.player1, m.player2, 0.95::DOUBLE - (contract_event % 5) / 100.0::DOUBLE AS conf, contract_event % 3 = 0 AS turned FROM pairs p JOIN matches m ON m.event_id = p.source_event_id WHERE p.started_at > TIMESTAMP '{NOW}'),
newest AS (SELECT c.* FROM canon c WHERE received_at <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY contract_event, market, side, line ORDER BY received_at DESC, snapshot_id DESC) = 1),
cand AS (SELECT n.snapshot_id, n.contract_event, n.market, n.side, n.line, CAST(n.odds AS DOUBLE) AS o, n.odds, n.received_at, e.* EXCLUDE (contract_event) FROM newest n JOIN em e ON e.contract_event = n.contract_event WHERE n.received_at < e.started_at),
h AS (SELECT event_id, started_at, available_at, sport, player1 AS player, player2 AS other, score1 AS gf, score2 AS ga FROM matches
  UNION ALL SELECT event_id, started_at, available_at, sport, player2, player1, score2, score1 FROM matches WHERE player1 <> player2),
looks AS (SELECT snapshot_id, source_event_id, received_at AS cutoff, sport, 1 AS side, player1 AS player, CAST(NULL AS BIGINT) AS other FROM cand
  UNION ALL SELECT snapshot_id, source_event_id, received_at, sport, 2, player2, NULL FROM cand
  UNION ALL SELECT snapshot_id, source_event_id, received_at, sport, 0, player1, player2 FROM cand),
f AS (SELECT l.snapshot_id, l.side, count(h.event_id) AS n, (count(*) FILTER (WHERE gf > ga) + 1.0::DOUBLE) / (count(h.event_id) + 3) AS w, (count(*) FILTER (WHERE gf = ga) + 1.0::DOUBLE) / (count(h.event_id) + 3) AS d,
    (count(*) FILTER (WHERE gf < ga) + 1.0::DOUBLE) / (count(h.event_id) + 3) AS l, coalesce(avg(gf + ga), 0) AS t
  FROM looks l LEFT JOIN h ON h.player = l.player AND h.sport = l.sport AND (l.other IS NULL OR h.other = l.other) AND h.event_id <> l.source_event_id AND h.started_at < l.cutoff AND h.available_at < l.cutoff GROUP BY l.snapshot_id, l.side),
w AS (SELECT c.*, least(a.n, b.n) AS samples, 0.35::DOUBLE * a.w + 0.35::DOUBLE * b.l + 0.3::DOUBLE * x.w AS q1, 0.35::DOUBLE * a.d + 0.35::DOUBLE * b.d + 0.3::DOUBLE * x.d AS qx,
    0.35::DOUBLE * a.l + 0.35::DOUBLE * b.w + 0.3::DOUBLE * x.l AS q2, greatest((1 - x.n / (x.n + 20.0::DOUBLE)) * ((a.t + b.t) / 2) + x.n / (x.n + 20.0::DOUBLE) * x.t, 1e-9) AS rate
  FROM cand c JOIN f a ON a.snapshot_id = c.snapshot_id AND a.side = 1 JOIN f b ON b.snapshot_id = c.snapshot_id AND b.side = 2 JOIN f x ON x.snapshot_id = c.snapshot_id AND x.side = 0),
mass AS (SELECT snapshot_id, coalesce(sum(exp(-rate) * pow(rate, k) / CAST(factorial(k) AS DOUBLE)) FILTER (WHERE k < line), 0) AS below, coalesce(sum(exp(-rate) * pow(rate, k) / CAST(factorial(k) AS DOUBLE)) FILTER (WHERE k = line), 0) AS push
  FROM w CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS k) WHERE market = 'total' GROUP BY snapshot_id),
priced AS (SELECT w.*, CASE WHEN market = '1x2' THEN 'results' ELSE 'totals' END AS strategy,
    CASE WHEN market = '1x2' THEN CASE WHEN side = 'X' THEN qx WHEN (side = 'P1') <> turned THEN q1 ELSE q2 END / (q1 + qx + q2)
      WHEN side = 'over' THEN (1 - below - push) / (1 - push) ELSE below / (1 - push) END AS p FROM w LEFT JOIN mass USING (snapshot_id)),
cor AS (SELECT CASE market WHEN 'O' THEN 'P1' ELSE 'X' END AS selection, CAST(floor((odds - 1) / 0.25) AS BIGINT) AS bucket, {METRICS} FROM bets GROUP BY market, floor((odds - 1) / 0.25)),
verd AS (SELECT selection, bucket, CASE WHEN roi_percent > 0 AND win_rate > implied THEN 'confirm' WHEN roi_percent < 0 AND win_rate < implied THEN 'conflict' ELSE 'neutral' END AS verdict FROM cor WHERE sample_size >= 30),
judged AS (SELECT p.*, (o * p - 1) * 100 AS v, p.strategy = 'results' AS res, v2.verdict, (epoch_us(least(started_at, received_at + CASE WHEN strategy = 'results' THEN INTERVAL 6 HOUR ELSE INTERVAL 12 HOUR END)) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 AS lead_s,
    (epoch_us(TIMESTAMP '{NOW}') - epoch_us(received_at)) / 1e6 AS age FROM priced p LEFT JOIN verd v2 ON p.strategy = 'results' AND p.sport = 'football' AND v2.selection = p.side AND v2.bucket = CAST(floor((p.odds - 1) / 0.25) AS BIGINT)),
base AS (SELECT *, list_filter([CASE WHEN samples < 5 THEN 'insufficient_sample' END, CASE WHEN res AND (o < 1.2 OR o > 10) OR NOT res AND (o < 1.01 OR o > 100) THEN 'odds_out_of_range' END,
    CASE WHEN v < 0 THEN 'below_minimum_value' END, CASE WHEN age > CASE WHEN res THEN 21600 ELSE 43200 END THEN 'stale_odds' END, CASE WHEN v > 500 THEN 'suspiciously_high_edge' END,
    CASE WHEN o < 1 / p * CASE WHEN res THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END THEN 'below_minimum_odds' END], lambda x: x IS NOT NULL) AS r0 FROM judged),
gated AS (SELECT *, CASE WHEN len(r0) = 0 AND res AND verdict IS NULL THEN ['corridor_unavailable'] WHEN len(r0) = 0 AND res AND verdict <> 'confirm' THEN ['corridor_not_confirmed'] WHEN len(r0) = 0 AND lead_s < 15 THEN ['insufficient_delivery_window'] ELSE r0 END AS r1 FROM base),
ranked AS (SELECT snapshot_id, row_number() OVER (PARTITION BY strategy, contract_event, market ORDER BY v DESC, p DESC) AS rn FROM gated WHERE len(r1) = 0)"""


@query("live_signals", f"""{_LIVE_SQL}
SELECT g.strategy, g.snapshot_id, CAST(g.samples AS BIGINT) AS sample_size, round(g.p, 6) AS probability, round(g.v, 7) AS value_percent, CASE WHEN rn = 1 THEN 'alert' ELSE 'skip' END AS decision,
  array_to_string(CASE WHEN rn > 1 THEN ['better_selection_available'] ELSE r1 END, ',') AS filter_reasons, 1.5::DOUBLE AS stake_percent
FROM gated g LEFT JOIN ranked r ON r.snapshot_id = g.snapshot_id""")
def live_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live run: newest quotes, features at quote time, filters, corridors, best alert."""
    return _live_run(spark, live_inputs(spark, sf_dir))


_LATER_SQL = _LIVE_SQL.replace(
    "WHERE n.received_at < e.started_at)", "WHERE n.received_at < e.started_at AND NOT (n.market = '1x2' AND n.snapshot_id % 3 = 0))"
)


@query("later_live_signals", f"""{_LATER_SQL}
SELECT g.strategy, g.snapshot_id, CAST(g.samples AS BIGINT) AS sample_size, round(g.p, 6) AS probability, round(g.v, 7) AS value_percent, CASE WHEN rn = 1 THEN 'alert' ELSE 'skip' END AS decision,
  array_to_string(CASE WHEN rn > 1 THEN ['better_selection_available'] ELSE r1 END, ',') AS filter_reasons, 1.5::DOUBLE AS stake_percent
FROM gated g LEFT JOIN ranked r ON r.snapshot_id = g.snapshot_id""")
def later_live_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run: snapshots that a model of the same version has predicted are left out, and no older quote takes their place."""
    inputs = live_inputs(spark, sf_dir)
    known = F.explode(
        F.array(
            F.struct(F.lit(live.RESULT_MODEL).alias("model_name"), F.lit("v1").alias("model_version"), (F.col("snapshot_id") % 3 == 0).alias("done")),
            F.struct(F.lit(live.TOTAL_MODEL).alias("model_name"), F.lit("v0").alias("model_version"), F.lit(True).alias("done")),
        )
    )
    predicted = inputs["quotes"].select("snapshot_id", known.alias("m")).where("m.done").select("snapshot_id", "m.model_name", "m.model_version")
    return _live_run(spark, inputs, predicted=predicted)


def _live_run(spark: SparkSession, inputs: dict[str, DataFrame], **options) -> DataFrame:
    from oddsloom.operators import corridors

    out = live.generate_signals(
        inputs["quotes"], inputs["matches"], inputs["history"], strategies(spark, LIVE),
        corridors.build(inputs["bets"]), now=F.lit(NOW).cast("timestamp"), **options,
    )
    return out.select(
        "strategy", "snapshot_id", "sample_size", F.round("probability", 6).alias("probability"),
        F.round("value_percent", 7).alias("value_percent"), "decision",
        F.array_join("filter_reasons", ",").alias("filter_reasons"),
        F.col("stake_percent").cast("double").alias("stake_percent"),
    )
