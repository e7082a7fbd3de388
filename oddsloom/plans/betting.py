"""Queries on signal filters, bankroll paths and market results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import settlement
from oddsloom.operators import baselines, simulate
from oddsloom.operators import quotes as quote_ops
from oddsloom.plans import bindings
from oddsloom.plans.form import rounded
from oddsloom.plans.pricing import CANONICAL
from oddsloom.plans.probability import FORM_SQL, MIN_SAMPLES, cells
from oddsloom.plans.registry import query
from oddsloom.sources.strategies import strategies

STRATEGIES = {
    "flat": {"safety_multiplier": 1.05, "min_samples": 5, "stake_mode": "fixed", "base_stake": 1.0,
             "min_odds": 1.2, "max_odds": 10.0, "stale_after_seconds": 120.0, "suspicious_edge_percent": 50.0},
    "observed": {"min_samples": 12, "min_h2h": 1, "stake_mode": "observed_ml", "base_stake": 0.5,
                 "allowed_markets": ["1x2"], "min_probability": 0.05, "max_probability": 0.9},
    "kelly": {"stake_mode": "kelly_0_1", "min_match_confidence": 0.95, "allowed_tournaments": ["T0", "T2"],
              "min_value_percent": 2.0},
}


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate bet per quote; a quote that comes too late opens a market that starts 150 s after it."""
    quotes = settlement.canonicalize(bindings.quotes(spark, sf_dir))
    snapshot, price = F.col("snapshot_id"), F.col("odds").cast("double")
    received = F.unix_micros("received_at")
    edge = 0.8 + (snapshot % 60) / 100.0
    start = F.greatest(F.col("kickoff"), F.timestamp_micros(received + 150_000_000))
    return quotes.select(
        F.col("contract_event").alias("event_id"),
        start.alias("event_started_at"),
        F.timestamp_micros(received + (snapshot % 150) * 1_000_000).alias("decision_at"),
        F.col("received_at").alias("feature_cutoff_at"),
        F.col("received_at").alias("odds_received_at"),
        snapshot.alias("odds_snapshot_id"),
        F.least(F.lit(0.999), edge / price).alias("probability"),
        "odds", "market", "selection", "line",
        F.concat(F.lit("T"), (snapshot % 4).cast("string")).alias("tournament"),
        (snapshot % 40).alias("sample_size"),
        (snapshot % 5).alias("h2h_samples"),
        (0.85 + (snapshot % 16) / 100.0).alias("match_confidence"),
        "score1", "score2",
    )


def strategy_bets(spark: SparkSession, sf_dir: str, definitions: dict) -> DataFrame:
    """Each opportunity under each strategy, strategies attached by name.

    The configured strategies are sent to the opportunities; a shuffle by name would make one task a strategy.
    """
    table = strategies(spark, definitions).drop("source", "prediction_enabled", "alerts_enabled")
    names = F.explode(F.array(*[F.lit(name) for name in definitions]))
    return opportunities(spark, sf_dir).withColumn("strategy", names).join(F.broadcast(table), "strategy")


_OPPORTUNITIES = f"""{bindings.with_views('quotes')}, {CANONICAL},
opps AS (SELECT contract_event AS event_id, kickoff, epoch_us(received_at) + (snapshot_id % 150) * 1000000 AS decision_us, epoch_us(received_at) AS received_us,
    snapshot_id AS odds_snapshot_id, least(0.999::DOUBLE, (0.8::DOUBLE + (snapshot_id % 60) / 100.0::DOUBLE) / CAST(odds AS DOUBLE)) AS p, CAST(odds AS DOUBLE) AS o,
    market, side AS selection, line, 'T' || (snapshot_id % 4) AS tournament, snapshot_id % 40 AS n, snapshot_id % 5 AS h, 0.85::DOUBLE + (snapshot_id % 16) / 100.0::DOUBLE AS conf,
    score1, score2 FROM canon),
strat AS (SELECT * FROM (VALUES
  ('flat', 1.05::DOUBLE, 5, 0, 1.2::DOUBLE, 10.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.9::DOUBLE, 'fixed', 1.0::DOUBLE, [], []),
  ('observed', 1.0, 12, 1, 1.01, 100.0, 0.05, 0.9, 0.0, 0.9, 'observed_ml', 0.5, ['1x2'], []),
  ('kelly', 1.0, 0, 0, 1.01, 100.0, 0.0, 1.0, 2.0, 0.95, 'kelly_0_1', 1.0, [], ['T0', 'T2']))
  AS s(strategy, safety, min_n, min_h, min_o, max_o, min_p, max_p, min_v, min_conf, mode, base, markets, tournaments)),
valued AS (SELECT *, o * p AS ratio, (o * p - 1) * 100 AS v FROM opps CROSS JOIN strat),
reasoned AS (SELECT *, list_filter([
    CASE WHEN n < min_n THEN 'insufficient_sample' END, CASE WHEN h < min_h THEN 'insufficient_h2h' END,
    CASE WHEN o < min_o OR o > max_o THEN 'odds_out_of_range' END, CASE WHEN p < min_p OR p > max_p THEN 'probability_out_of_range' END,
    CASE WHEN v < min_v THEN 'below_minimum_value' END,
    CASE WHEN len(markets) > 0 AND NOT list_contains(markets, market) THEN 'market_not_allowed' END,
    CASE WHEN len(tournaments) > 0 AND NOT list_contains(tournaments, tournament) THEN 'tournament_not_allowed' END,
    CASE WHEN conf < min_conf THEN 'event_match_confidence' END, CASE WHEN decision_us - received_us > 120000000 THEN 'stale_odds' END,
    CASE WHEN v > 50 THEN 'suspiciously_high_edge' END, CASE WHEN o < 1 / p * safety THEN 'below_minimum_odds' END], lambda x: x IS NOT NULL) AS base_reasons,
    list_filter([CASE WHEN conf < min_conf THEN 'incorrect_event_mapping' END, CASE WHEN decision_us - received_us > 120000000 THEN 'stale_odds' END,
    CASE WHEN v > 50 THEN 'suspiciously_high_edge' END], lambda x: x IS NOT NULL) AS flags,
    greatest(0, ((o - 1) * p - (1 - p)) / (o - 1)) * 0.1::DOUBLE AS kelly, base * least(3, greatest(0, (ratio - 1) * 10)) AS observed_stake FROM valued),
decided AS (SELECT *, CASE WHEN len(base_reasons) = 0 AND ((mode = 'observed_ml' AND observed_stake <= 0) OR (mode = 'kelly_0_1' AND kelly <= 0))
    THEN ['zero_stake'] ELSE base_reasons END AS reasons FROM reasoned),
outcomes AS (SELECT *, CASE WHEN len(reasons) > 0 THEN NULL
    WHEN selection = 'P1' THEN CASE WHEN score1 > score2 THEN 'win' ELSE 'loss' END
    WHEN selection = 'P2' THEN CASE WHEN score2 > score1 THEN 'win' ELSE 'loss' END
    WHEN selection = 'X' THEN CASE WHEN score1 = score2 THEN 'win' ELSE 'loss' END
    WHEN score1 + score2 = line THEN 'return'
    WHEN (score1 + score2 > line) = (selection = 'over') THEN 'win' ELSE 'loss' END AS outcome FROM decided),
gains AS (SELECT *, CASE outcome WHEN 'win' THEN o - 1 WHEN 'loss' THEN -1 ELSE 0 END AS gain,
    CASE mode WHEN 'fixed' THEN base WHEN 'observed_ml' THEN observed_stake ELSE 0 END AS unit FROM outcomes WHERE len(reasons) = 0),
paths AS (SELECT *, CASE WHEN mode = 'kelly_0_1' THEN 100 * exp(coalesce(sum(ln(1 + kelly * gain)) OVER before, 0))
    ELSE 100 + coalesce(sum(unit * gain) OVER before, 0) END AS bankroll_before
  FROM gains WINDOW before AS (PARTITION BY strategy ORDER BY decision_us, event_id, odds_snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
staked AS (SELECT *, CASE WHEN mode = 'kelly_0_1' THEN bankroll_before * kelly ELSE unit END AS stake FROM paths),
bets AS (SELECT *, stake * gain AS profit FROM staked)"""


@query("signal_filter_reasons", f"""{_OPPORTUNITIES}
SELECT strategy, odds_snapshot_id, CASE WHEN len(reasons) = 0 THEN 'alert' ELSE 'skip' END AS decision,
  array_to_string(reasons, ',') AS filter_reasons, array_to_string(flags, ',') AS anomaly_flags FROM decided""")
def signal_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = simulate.decide(strategy_bets(spark, sf_dir, STRATEGIES))
    return decided.select(
        "strategy", "odds_snapshot_id", "decision",
        F.array_join("filter_reasons", ",").alias("filter_reasons"),
        F.array_join("anomaly_flags", ",").alias("anomaly_flags"),
    )


@query("bankroll_path", f"""{_OPPORTUNITIES}
SELECT strategy, odds_snapshot_id, outcome, round(bankroll_before, 6) AS bankroll_before, round(stake, 6) AS stake, round(profit, 6) AS profit FROM bets""")
def bankroll_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes and bankrolls of the bets each strategy places, in order."""
    run = simulate.simulate(simulate.require_order(strategy_bets(spark, sf_dir, STRATEGIES)))
    bets = run.where("decision = 'alert'")
    return rounded(bets.select("strategy", "odds_snapshot_id", "outcome", "bankroll_before", "stake", "profit"))


@query("drawdown_streaks", f"""{_OPPORTUNITIES},
cum AS (SELECT *, sum(profit) OVER w AS c, count(*) FILTER (WHERE outcome = 'win') OVER w AS won FROM bets
  WINDOW w AS (PARTITION BY strategy ORDER BY decision_us, event_id, odds_snapshot_id)),
peak AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY strategy ORDER BY decision_us, event_id, odds_snapshot_id)) AS top FROM cum),
falls AS (SELECT strategy, greatest(max(top - c), 0) AS max_drawdown FROM peak GROUP BY strategy),
streaks AS (SELECT strategy, max(losses) AS longest_losing_streak FROM (SELECT strategy, won, count(*) FILTER (WHERE outcome = 'loss') AS losses FROM cum GROUP BY strategy, won) GROUP BY strategy),
tot AS (SELECT strategy, count(*) AS bets, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses,
    count(*) FILTER (WHERE outcome = 'return') AS returns, sum(stake) AS total_stake, sum(profit) AS profit, avg(o) AS average_odds,
    avg(pow(p - (outcome = 'win')::INT, 2)) FILTER (WHERE outcome IN ('win', 'loss')) AS brier_score,
    avg(CASE outcome WHEN 'win' THEN -ln(p) WHEN 'loss' THEN -ln(1 - p) END) AS log_loss FROM bets GROUP BY strategy),
seen AS (SELECT strategy, count(*) AS predictions FROM decided GROUP BY strategy)
SELECT strategy, predictions, bets, wins, losses, returns, CAST(0 AS BIGINT) AS unsettled, round(total_stake, 6) AS total_stake, round(profit, 6) AS profit,
  round(average_odds, 6) AS average_odds, round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss,
  round(100.0 * wins / (wins + losses), 6) AS hit_rate_percent, round(100 * profit / total_stake, 6) AS roi_percent, round(100 * profit / total_stake, 6) AS yield_percent,
  round(max_drawdown, 6) AS max_drawdown, longest_losing_streak
FROM tot JOIN falls USING (strategy) JOIN streaks USING (strategy) JOIN seen USING (strategy)""")
def drawdown_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = simulate.simulate(strategy_bets(spark, sf_dir, STRATEGIES))
    return rounded(simulate.run_metrics(run))


@query("temporal_guards", f"""{_OPPORTUNITIES}
SELECT odds_snapshot_id, 'quote came after the decision' AS violation FROM opps WHERE odds_snapshot_id % 97 = 0
UNION ALL SELECT odds_snapshot_id, 'decision falls after kickoff' FROM opps WHERE odds_snapshot_id % 97 = 1
UNION ALL SELECT odds_snapshot_id, 'features look past the decision' FROM opps WHERE odds_snapshot_id % 97 = 2""")
def temporal_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose clocks are out of order, after disturbing some of them."""
    case = F.col("odds_snapshot_id") % 97
    late = F.col("decision_at") + F.expr("INTERVAL 1 SECOND")
    broken = opportunities(spark, sf_dir).withColumns(
        {
            "odds_received_at": F.when(case == 0, late).otherwise(F.col("odds_received_at")),
            "event_started_at": F.when(case == 1, F.col("decision_at") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("event_started_at")),
            "feature_cutoff_at": F.when(case == 2, late).otherwise(F.col("feature_cutoff_at")),
        }
    )
    return simulate.temporal_violations(broken).select("odds_snapshot_id", "violation")


def market_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing quotes priced above the model's fair odds, settled."""
    closing = quote_ops.closing_quotes(
        quote_ops.canonical(bindings.quotes(spark, sf_dir)), max_age_seconds=12 * 3600
    )
    sized = baselines.with_sample_sizes(cells(spark, sf_dir, ()), ()).where(
        F.least("player1_samples", "player2_samples") >= MIN_SAMPLES
    ).withColumnRenamed("event_id", "snapshot_id")
    priced = closing.join(sized.drop("cutoff_at"), "snapshot_id")
    results = baselines.baseline_probabilities(
        priced.where("market = '1x2'"), (), ("individual_h2h_fixed",)
    )
    chance = F.when(F.col("selection") == "P1", F.col("p1")).when(
        F.col("selection") == "X", F.col("px")
    ).otherwise(F.col("p2"))
    totals = baselines.total_probabilities(priced.where("market = 'total'"), ())
    columns = ["market", "selection", "line", "odds", "score1", "score2"]
    bets = results.select(*columns, chance.alias("probability")).unionByName(
        totals.select(*columns, F.col("total_conditional").alias("probability"))
    )
    fair = 1.0 / F.greatest(F.col("probability"), F.lit(1e-12))
    return settlement.settle(bets.where(F.col("odds").cast("double") > fair))


@query("market_backtest", f"""{FORM_SQL}, {bindings.CTE['quotes']}, {CANONICAL},
closing AS (SELECT * FROM (SELECT * FROM canon WHERE received_at < kickoff
  QUALIFY row_number() OVER (PARTITION BY contract_event, market, side, line ORDER BY received_at DESC, snapshot_id DESC) = 1)
  WHERE kickoff - received_at <= INTERVAL 12 HOUR),
expect AS (SELECT r.event_id, r.samples, greatest((1 - h.matches / (h.matches + 20.0)) * r.players_total + h.matches / (h.matches + 20.0) * (h.f + h.a), 1e-9) AS rate
  FROM rates r JOIN hf h ON h.event_id = r.event_id AND h.last_n = 0),
mass AS (SELECT c.snapshot_id, coalesce(sum(exp(-rate) * pow(rate, k) / CAST(factorial(k) AS DOUBLE)) FILTER (WHERE k < c.line), 0) AS below,
    coalesce(sum(exp(-rate) * pow(rate, k) / CAST(factorial(k) AS DOUBLE)) FILTER (WHERE k = c.line), 0) AS push
  FROM closing c JOIN expect e ON e.event_id = c.snapshot_id CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS k) WHERE c.market = 'total' GROUP BY c.snapshot_id),
priced AS (
  SELECT c.*, CASE side WHEN 'P1' THEN m.p1 WHEN 'X' THEN m.px ELSE m.p2 END AS p FROM closing c JOIN models m ON m.event_id = c.snapshot_id AND m.model = 'individual_h2h_fixed' WHERE c.market = '1x2'
  UNION ALL SELECT c.*, CASE side WHEN 'over' THEN (1 - below - push) ELSE below END / (1 - push) FROM closing c JOIN mass m USING (snapshot_id)),
value AS (SELECT p.* FROM priced p JOIN expect e ON e.event_id = p.snapshot_id WHERE e.samples >= {MIN_SAMPLES} AND odds > 1 / greatest(p, 1e-12)),
won AS (SELECT *, CASE
    WHEN side = 'P1' THEN CASE WHEN score1 > score2 THEN 'win' ELSE 'loss' END
    WHEN side = 'P2' THEN CASE WHEN score2 > score1 THEN 'win' ELSE 'loss' END
    WHEN side = 'X' THEN CASE WHEN score1 = score2 THEN 'win' ELSE 'loss' END
    WHEN score1 + score2 = line THEN 'return'
    WHEN (score1 + score2 > line) = (side = 'over') THEN 'win' ELSE 'loss' END AS outcome FROM value),
keyed AS (SELECT '1x2' AS key, odds, outcome FROM won WHERE market = '1x2' UNION ALL SELECT 'total_' || side, odds, outcome FROM won WHERE market = 'total'
  UNION ALL SELECT 'total_' || side || '_' || CASE WHEN line = floor(line) THEN CAST(CAST(line AS INT) AS VARCHAR) ELSE CAST(CAST(line AS DECIMAL(10,1)) AS VARCHAR) END, odds, outcome FROM won WHERE market = 'total'),
agg AS (SELECT key, count(*) AS bets, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses,
  count(*) FILTER (WHERE outcome = 'return') AS returns, CAST(sum(CASE outcome WHEN 'win' THEN odds - 1 WHEN 'loss' THEN -1 ELSE 0 END) AS DOUBLE) AS profit FROM keyed GROUP BY key)
SELECT key, bets, wins, losses, returns, round(profit, 5) AS profit, round(CASE WHEN wins + losses > 0 THEN 100.0 * wins / (wins + losses) ELSE 0 END, 5) AS hit_rate_percent,
  CAST(bets AS DOUBLE) AS total_stake, round(100 * profit / bets, 5) AS roi_percent, round(100 * profit / bets, 5) AS yield_percent FROM agg""")
def market_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.market_results(market_bets(spark, sf_dir)), 5)
