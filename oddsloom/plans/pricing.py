"""Queries on quotes: notation, settlement, value, movement, margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import odds as odds_fn
from oddsloom.functions import settlement
from oddsloom.operators import quotes as quote_ops
from oddsloom.plans import bindings
from oddsloom.plans.form import rounded
from oddsloom.plans.registry import query

QUOTES = bindings.with_views("quotes")
CANONICAL = """canon AS (SELECT *, CASE WHEN market = '1x2' THEN selection WHEN selection LIKE 'TM(%' THEN 'under' ELSE selection END AS side FROM quotes)"""
PROBABILITY = "(snapshot_id % 90 + 5) / 100.0::DOUBLE"


def model_probability() -> Column:
    """A probability per quote, derived from its id."""
    return (F.col("snapshot_id") % 90 + 5) / F.lit(100.0)


@query("canonical_selection", f"""{QUOTES}, {CANONICAL}
SELECT snapshot_id, market, selection AS raw_selection, side AS selection, CAST(line AS DOUBLE) AS line FROM canon""")
def canonical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = settlement.canonicalize(bindings.quotes(spark, sf_dir))
    return read.select(
        "snapshot_id", "market", "raw_selection", "selection", F.col("line").cast("double").alias("line")
    )


@query("settled_quotes", f"""{QUOTES}, {CANONICAL},
won AS (SELECT *, CASE
    WHEN side = 'P1' THEN CASE WHEN score1 > score2 THEN 'win' ELSE 'loss' END
    WHEN side = 'P2' THEN CASE WHEN score2 > score1 THEN 'win' ELSE 'loss' END
    WHEN side = 'X' THEN CASE WHEN score1 = score2 THEN 'win' ELSE 'loss' END
    WHEN score1 + score2 = line THEN 'return'
    WHEN (score1 + score2 > line) = (side = 'over') THEN 'win' ELSE 'loss' END AS outcome FROM canon)
SELECT snapshot_id, side AS selection, outcome,
  CAST(CASE outcome WHEN 'win' THEN odds * 2 WHEN 'return' THEN 2 ELSE 0 END AS DOUBLE) AS payout,
  CAST(CASE outcome WHEN 'win' THEN odds * 2 - 2 WHEN 'return' THEN 0 ELSE -2 END AS DOUBLE) AS profit
FROM won""")
def settled_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two units on every quote, settled."""
    read = settlement.settle(settlement.canonicalize(bindings.quotes(spark, sf_dir)))
    paid = settlement.with_payout(read.withColumn("stake", F.lit(2).cast("decimal(14,2)")))
    return paid.select(
        "snapshot_id", "selection", "outcome",
        F.col("payout").cast("double").alias("payout"), F.col("profit").cast("double").alias("profit"),
    )


_NOTATIONS = ("П1", " p2 ", "1X", "X2", "12", "F1(-0.5)", "Ф2(+1,5)", "F1(0.25)", "ТБ 2,5", "tm(3)", "Х", "1st goal")


@query("notation_settlement", f"""{QUOTES},
given AS (SELECT snapshot_id, snapshot_id % 12 AS form, score1 AS a, score2 AS b FROM quotes)
SELECT snapshot_id, CASE form
  WHEN 0 THEN CASE WHEN a > b THEN 'win' ELSE 'loss' END
  WHEN 1 THEN CASE WHEN b > a THEN 'win' ELSE 'loss' END
  WHEN 2 THEN CASE WHEN a >= b THEN 'win' ELSE 'loss' END
  WHEN 3 THEN CASE WHEN b >= a THEN 'win' ELSE 'loss' END
  WHEN 4 THEN CASE WHEN a <> b THEN 'win' ELSE 'loss' END
  WHEN 5 THEN CASE WHEN a - 0.5 > b THEN 'win' ELSE 'loss' END
  WHEN 6 THEN CASE WHEN b + 1.5 > a THEN 'win' ELSE 'loss' END
  WHEN 8 THEN CASE WHEN a + b > 2.5 THEN 'win' ELSE 'loss' END
  WHEN 9 THEN CASE WHEN a + b < 3 THEN 'win' WHEN a + b = 3 THEN 'return' ELSE 'loss' END
  WHEN 10 THEN CASE WHEN a = b THEN 'win' ELSE 'loss' END END AS outcome
FROM given""")
def notation_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts given by text alone: double chance, handicap, old totals."""
    texts = F.array(*[F.lit(text) for text in _NOTATIONS])
    text = F.element_at(texts, (F.col("snapshot_id") % len(_NOTATIONS) + 1).cast("int"))
    return bindings.quotes(spark, sf_dir).select(
        "snapshot_id",
        settlement.notation_outcome(text, F.col("score1"), F.col("score2")).alias("outcome"),
    )


@query("handicap_settlement", f"""{QUOTES},
given AS (SELECT snapshot_id, score1 AS a, score2 AS b, 1 + snapshot_id % 2 AS side, (snapshot_id % 9 - 4) / 4.0::DOUBLE AS line FROM quotes)
SELECT snapshot_id, CASE WHEN line * 2 <> floor(line * 2) THEN NULL
   WHEN side = 1 THEN CASE WHEN a + line = b THEN 'return' WHEN a + line > b THEN 'win' ELSE 'loss' END
   ELSE CASE WHEN b + line = a THEN 'return' WHEN b + line > a THEN 'win' ELSE 'loss' END END AS outcome,
  CASE WHEN line * 2 <> floor(line * 2) THEN 'quarter_line' END AS error_reason
FROM given""")
def handicap_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = bindings.quotes(spark, sf_dir).select(
        "snapshot_id", "score1", "score2",
        F.lit("handicap").alias("market"),
        F.concat(F.lit("F"), (1 + F.col("snapshot_id") % 2).cast("string"), F.lit("(x)")).alias("selection"),
        ((F.col("snapshot_id") % 9 - 4) / 4.0).cast("decimal(10,3)").alias("line"),
    )
    return settlement.settle(contracts).select("snapshot_id", "outcome", "error_reason")


@query("oriented_scores", f"""{QUOTES}
SELECT snapshot_id, CASE WHEN snapshot_id % 3 = 0 THEN score2 ELSE score1 END AS score1,
  CASE WHEN snapshot_id % 3 = 0 THEN score1 ELSE score2 END AS score2 FROM quotes""")
def oriented_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores turned to the book's sides; the frozen flag wins over the recorded one."""
    snapshot = F.col("snapshot_id")
    frozen = F.when(snapshot % 2 == 0, snapshot % 3 == 0)
    recorded = F.when(snapshot % 2 == 0, F.lit(True)).otherwise(snapshot % 3 == 0)
    flag = settlement.reversed_flag(frozen, recorded)
    s1, s2 = settlement.orient(F.col("score1"), F.col("score2"), flag)
    return bindings.quotes(spark, sf_dir).select(
        "snapshot_id", s1.cast("long").alias("score1"), s2.cast("long").alias("score2")
    )


@query("value_metrics", f"""{QUOTES}
SELECT snapshot_id, {PROBABILITY} AS probability, round(1 / ({PROBABILITY}), 6) AS fair_odds,
  round(CAST(odds AS DOUBLE) * {PROBABILITY}, 9) AS value_ratio,
  round((CAST(odds AS DOUBLE) * {PROBABILITY} - 1) * 100, 7) AS value_percent,
  round(1 / ({PROBABILITY}) * 1.15::DOUBLE, 6) AS minimum_odds
FROM quotes""")
def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, price = model_probability(), F.col("odds")
    return bindings.quotes(spark, sf_dir).select(
        "snapshot_id", p.alias("probability"),
        F.round(odds_fn.fair_odds(p), 6).alias("fair_odds"),
        F.round(odds_fn.value_ratio(p, price), 9).alias("value_ratio"),
        F.round(odds_fn.value_percent(p, price), 7).alias("value_percent"),
        F.round(odds_fn.minimum_odds(p, F.lit(1.15)), 6).alias("minimum_odds"),
    )


@query("kelly_stakes", f"""{QUOTES}, priced AS (SELECT snapshot_id, CAST(odds AS DOUBLE) AS o, {PROBABILITY} AS p FROM quotes),
shares AS (SELECT *, greatest(0, ((o - 1) * p - (1 - p)) / (o - 1)) AS kelly, least(3, greatest(0, (o * p - 1) * 10)) AS multiplier FROM priced)
SELECT snapshot_id, round(kelly, 7) AS kelly_fraction, round(multiplier, 7) AS multiplier,
  round(2.5::DOUBLE * multiplier, 7) AS observed_stake, round(1000 * 0.1::DOUBLE * kelly, 7) AS kelly_tenth,
  round(least(1000 * 0.25::DOUBLE * kelly, 40), 7) AS kelly_quarter_capped
FROM shares""")
def kelly_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, price = model_probability(), F.col("odds")
    ratio = odds_fn.value_ratio(p, price)
    bank, no_cap = F.lit(1000.0), F.lit(None).cast("double")
    return rounded(
        bindings.quotes(spark, sf_dir).select(
            "snapshot_id",
            odds_fn.kelly_fraction(p, price).alias("kelly_fraction"),
            odds_fn.observed_multiplier(ratio).alias("multiplier"),
            odds_fn.unit_stake(F.lit("observed_ml"), F.lit(2.5), ratio).alias("observed_stake"),
            odds_fn.kelly_stake(bank, p, price, odds_fn.kelly_share(F.lit("kelly_0_1")), no_cap).alias("kelly_tenth"),
            odds_fn.kelly_stake(bank, p, price, odds_fn.kelly_share(F.lit("kelly_0_25")), F.lit(40.0)).alias("kelly_quarter_capped"),
        ),
        7,
    )


@query("live_stakes", f"""{QUOTES}, raw AS (SELECT snapshot_id, (snapshot_id % 31) / 10.0 AS m FROM quotes),
pct AS (SELECT snapshot_id, round_even(least(greatest(1.5 * m, 0.25), 3.0), 2) AS s FROM raw)
SELECT snapshot_id, CAST(s AS DOUBLE) AS stake_percent, CAST(s * 1000 AS DOUBLE) AS stake_amount FROM pct""")
def live_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped bankroll share with half-even rounding."""
    percent = odds_fn.live_stake_percent((F.col("snapshot_id") % 31) / 10.0)
    return bindings.quotes(spark, sf_dir).select(
        "snapshot_id", percent.cast("double").alias("stake_percent"),
        odds_fn.live_stake_amount(percent).cast("double").alias("stake_amount"),
    )


_CONTRACT = "contract_event, market, side AS selection, line"
_GROUP = "contract_event, market, side, line"


@query("closing_quotes", f"""{QUOTES}, {CANONICAL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY received_at DESC, snapshot_id DESC) AS rn FROM canon WHERE received_at < kickoff)
SELECT contract_event, market, side AS selection, CAST(line AS DOUBLE) AS line, snapshot_id, CAST(odds AS DOUBLE) AS odds
FROM ranked WHERE rn = 1 AND kickoff - received_at <= INTERVAL 12 HOUR""")
def closing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = quote_ops.closing_quotes(
        quote_ops.canonical(bindings.quotes(spark, sf_dir)), max_age_seconds=12 * 3600
    )
    return closing.select(
        "contract_event", "market", "selection", F.col("line").cast("double").alias("line"),
        "snapshot_id", F.col("odds").cast("double").alias("odds"),
    )


@query("latest_quotes", f"""{QUOTES}, {CANONICAL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY received_at DESC, snapshot_id DESC) AS rn
  FROM canon WHERE received_at <= TIMESTAMP '2024-01-15 12:00:00')
SELECT contract_event, market, side AS selection, CAST(line AS DOUBLE) AS line, snapshot_id, CAST(odds AS DOUBLE) AS odds FROM ranked WHERE rn = 1""")
def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return quote_ops.latest_quotes(bindings.quotes(spark, sf_dir), now).select(
        "contract_event", "market", "selection", F.col("line").cast("double").alias("line"),
        "snapshot_id", F.col("odds").cast("double").alias("odds"),
    )


_MOVEMENT_KEYS = ("contract_event", "market")


@query("odds_movement", f"""{QUOTES},
ends AS (SELECT contract_event, market, arg_min(odds, received_at) AS o, arg_max(odds, received_at) AS c,
  min(received_at) AS a, max(received_at) AS b, count(*) AS observations
  FROM quotes WHERE received_at < kickoff GROUP BY contract_event, market)
SELECT contract_event, market, CAST(o AS DOUBLE) AS opening_odds, CAST(c AS DOUBLE) AS current_odds,
  round(CAST(c AS DOUBLE) - CAST(o AS DOUBLE), 6) AS change_absolute,
  round(100 * (CAST(c AS DOUBLE) - CAST(o AS DOUBLE)) / CAST(o AS DOUBLE), 6) AS change_percent,
  round((epoch_us(b) - epoch_us(a)) / 1e6, 6) AS seconds_since_open, observations
FROM ends""")
def odds_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quote_ops.odds_movement(bindings.quotes(spark, sf_dir), _MOVEMENT_KEYS))


@query("implied_probability", f"""{QUOTES}, {CANONICAL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY received_at DESC, snapshot_id DESC) AS rn FROM canon WHERE received_at < kickoff),
raw AS (SELECT contract_event, market, line, side AS selection, 1 / CAST(odds AS DOUBLE) AS p,
  count(*) OVER m AS sides, sum(1 / CAST(odds AS DOUBLE)) OVER m AS book FROM ranked WHERE rn = 1 WINDOW m AS (PARTITION BY contract_event, market, line))
SELECT contract_event, market, CAST(line AS DOUBLE) AS line, selection, round(p, 8) AS raw_probability,
  round(p / book, 8) AS normalized_probability, round(book, 8) AS overround FROM raw WHERE sides >= 2""")
def implied_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = quote_ops.closing_quotes(quote_ops.canonical(bindings.quotes(spark, sf_dir)))
    fair = quote_ops.implied_probabilities(closing, ["contract_event", "market", "line"])
    return rounded(fair.withColumn("line", F.col("line").cast("double")).drop("odds"), 8)


@query("alert_keys", f"""{QUOTES}, {CANONICAL}
SELECT snapshot_id, 'main:' || contract_event || ':' || market || ':' || side || ':' ||
  CASE WHEN line IS NULL THEN '-' WHEN line = floor(line) THEN CAST(CAST(line AS INT) AS VARCHAR) ELSE CAST(CAST(line AS DECIMAL(10,1)) AS VARCHAR) END AS alert_key,
  least(epoch_us(kickoff), epoch_us(received_at) + 120000000) AS expires_us FROM canon""")
def alert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = settlement.canonicalize(bindings.quotes(spark, sf_dir))
    key = odds_fn.alert_key(
        F.lit("main"), F.col("contract_event"), F.col("market"), F.col("selection"), F.col("line")
    )
    expiry = odds_fn.delivery_expiry(F.col("kickoff"), F.col("received_at"), F.lit(120.0))
    return read.select("snapshot_id", key.alias("alert_key"), F.unix_micros(expiry).alias("expires_us"))


@query("formula_inference", f"""{QUOTES},
given AS (SELECT snapshot_id, CAST(odds AS DOUBLE) AS odds, CASE WHEN snapshot_id % 4 <> 0 THEN (snapshot_id % 80) / 100.0::DOUBLE + 0.05 END AS ratio,
  CASE WHEN snapshot_id % 3 <> 0 THEN CAST(odds AS DOUBLE) * 0.9 END AS mo, CASE WHEN snapshot_id % 5 <> 0 THEN (snapshot_id % 30) / 10.0::DOUBLE END AS bet_mul,
  CASE WHEN snapshot_id % 6 <> 0 THEN (snapshot_id % 40) / 100.0::DOUBLE END AS shown FROM quotes)
SELECT snapshot_id, round(ratio / odds, 8) AS inferred_probability, round(1 / (ratio / odds), 8) AS inferred_fair_odds,
  round((ratio - 1) * 100, 8) AS predicted_value_percent, round(mo / (1 / (ratio / odds)), 8) AS inferred_safety_multiplier,
  round(CASE WHEN ratio IS NOT NULL THEN least(3, greatest(0, (ratio - 1) * 10)) END, 8) AS predicted_bet_mul,
  round(shown * 100 - (ratio - 1) * 100, 8) AS value_percent_delta,
  round(bet_mul - CASE WHEN ratio IS NOT NULL THEN least(3, greatest(0, (ratio - 1) * 10)) END, 8) AS bet_mul_delta,
  round(mo - 1 / (ratio / odds), 8) AS mo_minus_fair_odds
FROM given""")
def formula_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observed alert implies; a missing input leaves its results null."""
    snapshot, price = F.col("snapshot_id"), F.col("odds").cast("double")
    observed = bindings.quotes(spark, sf_dir).select(
        "snapshot_id", price.alias("odds"),
        F.when(snapshot % 4 != 0, (snapshot % 80) / 100.0 + 0.05).alias("v"),
        F.when(snapshot % 3 != 0, price * 0.9).alias("mo"),
        F.when(snapshot % 5 != 0, (snapshot % 30) / 10.0).alias("bet_mul"),
        F.when(snapshot % 6 != 0, (snapshot % 40) / 100.0).alias("shown_value"),
    )
    return rounded(infer_formula(observed).drop("odds", "v", "mo", "bet_mul", "shown_value"), 8)


def infer_formula(observed: DataFrame) -> DataFrame:
    """Derived columns of observations with odds, v, mo, bet_mul and shown_value."""
    chance = F.col("v") / F.col("odds")
    fair = 1.0 / chance
    percent = (F.col("v") - 1.0) * 100.0
    multiplier = F.when(F.col("v").isNotNull(), odds_fn.observed_multiplier(F.col("v")))
    return observed.withColumns(
        {
            "inferred_probability": chance,
            "inferred_fair_odds": fair,
            "predicted_value_percent": percent,
            "inferred_safety_multiplier": F.col("mo") / fair,
            "predicted_bet_mul": multiplier,
            "value_percent_delta": F.col("shown_value") * 100.0 - percent,
            "bet_mul_delta": F.col("bet_mul") - multiplier,
            "mo_minus_fair_odds": F.col("mo") - fair,
        }
    )
