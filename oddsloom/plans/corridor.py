"""Queries on odds corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import corridors as ops
from oddsloom.operators import quotes as quote_ops
from oddsloom.functions import settlement
from oddsloom.plans import bindings
from oddsloom.plans.form import rounded
from oddsloom.plans.pricing import CANONICAL
from oddsloom.plans.registry import query

METRICS = """CAST(count(*) AS BIGINT) AS sample_size, count(*) FILTER (WHERE outcome = 'win') AS wins,
  count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'return') AS returns,
  count(*) FILTER (WHERE outcome = 'win') / count(*) AS win_rate, CAST(sum(odds) AS DOUBLE) / count(*) AS average_odds,
  sum(1 / CAST(odds AS DOUBLE)) / count(*) AS implied,
  CAST(sum(CASE outcome WHEN 'win' THEN odds - 1 WHEN 'loss' THEN -1 ELSE 0 END) AS DOUBLE) / count(*) * 100 AS roi_percent"""
SHAPE = """round(win_rate, 6) AS win_rate, round(average_odds, 6) AS average_odds, round(implied, 6) AS average_implied_probability,
  round(roi_percent, 6) AS roi_percent, round((win_rate - implied) * 100, 6) AS edge_percent,
  CAST(round_even(CAST(least(1, sample_size / 100.0::DOUBLE) * greatest(0, 1 - least(1, 3.92::DOUBLE * sqrt(greatest(0, win_rate * (1 - win_rate) / sample_size)))) AS DECIMAL(18,12)), 4) AS DOUBLE) AS confidence"""
VERDICT = """CASE WHEN sample_size < 20 THEN 'insufficient' WHEN roi_percent > 0 AND win_rate > implied THEN 'confirm'
  WHEN roi_percent < 0 AND win_rate < implied THEN 'conflict' ELSE 'neutral' END AS verdict"""
BUCKETS = f"""scoped AS (
  SELECT market, 'global' AS scope_type, '' AS scope_value, odds, outcome FROM bets
  UNION ALL SELECT market, 'tournament_family', family, odds, outcome FROM bets WHERE family <> ''),
grouped AS (SELECT market, scope_type, scope_value, CAST(floor((odds - 1) / 0.25) AS BIGINT) AS bucket, {METRICS}
  FROM scoped GROUP BY market, scope_type, scope_value, floor((odds - 1) / 0.25)),
corridors AS (SELECT * FROM grouped WHERE sample_size >= 20)"""


def bet_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build(bindings.bets(spark, sf_dir), group=("market",))


@query("corridors", f"""{bindings.with_views('bets')}, {BUCKETS}
SELECT market, scope_type, scope_value, bucket, 1 + bucket * 0.25::DOUBLE AS odds_min, 1 + (bucket + 1) * 0.25::DOUBLE AS odds_max,
  sample_size, wins, losses, returns, {SHAPE}, {VERDICT} FROM corridors""")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ops.with_verdict(bet_corridors(spark, sf_dir))
    shaped = built.withColumns(
        {name: F.col(name).cast("double") for name in ("odds_min", "odds_max")}
    )
    return rounded(shaped)


@query("top_corridors", f"""{bindings.with_views('bets')}, {BUCKETS}
SELECT market, scope_type, scope_value, bucket, sample_size, round(roi_percent, 6) AS roi_percent
FROM corridors ORDER BY corridors.roi_percent DESC, sample_size DESC, market, scope_type, scope_value, bucket LIMIT 30""")
def top_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ops.top(bet_corridors(spark, sf_dir))
    return rounded(best.select("market", "scope_type", "scope_value", "bucket", "sample_size", "roi_percent"))


@query("corridor_statistics", f"""{bindings.with_views('bets')}, {BUCKETS}
SELECT (SELECT count(*) FROM bets) AS observations, (SELECT count(*) FROM bets WHERE outcome = 'return') AS observations_returned,
  count(*) AS buckets_written, count(*) FILTER (WHERE scope_type = 'global') AS global_buckets,
  count(*) FILTER (WHERE scope_type <> 'global') AS tournament_buckets FROM corridors""")
def corridor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_statistics(bindings.bets(spark, sf_dir), bet_corridors(spark, sf_dir))


@query("corridor_lookup", f"""{bindings.with_views('bets', 'quotes')}, {BUCKETS},
probes AS (SELECT snapshot_id, CASE market WHEN '1x2' THEN 'O' ELSE 'F' END AS market, CASE snapshot_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '3-MEDIUM' ELSE '' END AS family,
  CAST(floor((odds - 1) / 0.25) AS BIGINT) AS bucket FROM quotes),
found AS (SELECT p.snapshot_id, c.*, row_number() OVER (PARTITION BY p.snapshot_id ORDER BY (c.scope_type = 'tournament_family') DESC, c.sample_size DESC) AS rn
  FROM probes p JOIN corridors c ON c.market = p.market AND c.bucket = p.bucket
   AND (c.scope_type = 'global' OR (c.scope_type = 'tournament_family' AND c.scope_value = p.family)))
SELECT p.snapshot_id, f.scope_type AS corridor_scope_type, f.sample_size AS corridor_sample_size, round(f.roi_percent, 6) AS corridor_roi_percent
FROM probes p LEFT JOIN found f ON f.snapshot_id = p.snapshot_id AND f.rn = 1""")
def corridor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = bindings.quotes(spark, sf_dir).select(
        "snapshot_id",
        F.when(F.col("market") == "1x2", "O").otherwise("F").alias("market"),
        F.when(F.col("snapshot_id") % 3 == 0, "1-URGENT")
        .when(F.col("snapshot_id") % 3 == 1, "3-MEDIUM").otherwise("").alias("family"),
        "odds",
    )
    found = ops.lookup(probes, bet_corridors(spark, sf_dir), probe_id="snapshot_id", group=("market",))
    return rounded(
        found.select("snapshot_id", "corridor_scope_type", "corridor_sample_size", "corridor_roi_percent")
    )


@query("quote_corridors", f"""{bindings.with_views('quotes')}, {CANONICAL},
closing AS (SELECT * FROM canon WHERE received_at < kickoff
  QUALIFY row_number() OVER (PARTITION BY contract_event, market, side, line ORDER BY received_at DESC, snapshot_id DESC) = 1),
won AS (SELECT market, side AS selection, line, odds, CASE
    WHEN side = 'P1' THEN CASE WHEN score1 > score2 THEN 'win' ELSE 'loss' END
    WHEN side = 'P2' THEN CASE WHEN score2 > score1 THEN 'win' ELSE 'loss' END
    WHEN side = 'X' THEN CASE WHEN score1 = score2 THEN 'win' ELSE 'loss' END
    WHEN score1 + score2 = line THEN 'return'
    WHEN (score1 + score2 > line) = (side = 'over') THEN 'win' ELSE 'loss' END AS outcome FROM closing),
grouped AS (SELECT market, selection, line, CAST(floor((odds - 1) / 0.25) AS BIGINT) AS bucket, {METRICS}
  FROM won GROUP BY market, selection, line, floor((odds - 1) / 0.25))
SELECT market, selection, CAST(line AS DOUBLE) AS line, bucket, sample_size, wins, losses, returns, {SHAPE} FROM grouped WHERE sample_size >= 20""")
def quote_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors of closing quotes with a nullable line in the key."""
    closing = quote_ops.closing_quotes(quote_ops.canonical(bindings.quotes(spark, sf_dir)))
    observed = settlement.settle(closing).withColumn("family", F.lit(""))
    built = ops.build(observed, group=("market", "selection", "line"))
    return rounded(
        built.drop("scope_type", "scope_value", "odds_min", "odds_max").withColumn(
            "line", F.col("line").cast("double")
        )
    )


_REFRESH = f"""{bindings.with_views('quotes')},
obs AS (SELECT snapshot_id AS match_id, market, CASE WHEN snapshot_id % 4 = 0 THEN '' ELSE 'f' || (snapshot_id % 4) END AS family, odds,
    CASE WHEN score1 > score2 THEN 'win' WHEN score1 < score2 THEN 'loss' ELSE 'return' END AS outcome FROM quotes),
bets AS (SELECT market, family, CASE WHEN match_id % 10 = 3 THEN odds + 0.05::DECIMAL(12,5) ELSE odds END AS odds,
    CASE WHEN match_id % 10 = 4 AND outcome = 'loss' THEN 'win' ELSE outcome END AS outcome FROM obs WHERE match_id % 20 <> 2)"""


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored observations, their merge with a later run): a tenth is new, a tenth not found again, half of that unmatched."""
    match, day = F.col("match_id"), F.lit("2024-02-01").cast("timestamp")
    snapshot = F.col("snapshot_id")
    found = bindings.quotes(spark, sf_dir).select(
        snapshot.alias("match_id"), "market", F.lit("any").alias("selection"), F.lit(None).cast("decimal(10,3)").alias("line"),
        F.when(snapshot % 4 == 0, "").otherwise(F.concat(F.lit("f"), (snapshot % 4).cast("string"))).alias("family"), "odds",
        F.when(F.col("score1") > F.col("score2"), "win").when(F.col("score1") < F.col("score2"), "loss").otherwise("return").alias("outcome"),
    )
    stored = found.where(match % 10 != 1).withColumns(
        {"is_active": F.lit(True), "created_at": day, "invalidated_at": F.lit(None).cast("timestamp")}
    )
    changed = F.when((match % 10 == 4) & (F.col("outcome") == "loss"), "win").otherwise(F.col("outcome"))
    fresh = found.where(match % 10 != 2).withColumns(
        {
            "odds": (F.col("odds") + F.when(match % 10 == 3, 0.05).otherwise(0).cast("decimal(12,5)")).cast("decimal(12,5)"),
            "outcome": changed,
        }
    )
    matched = found.where(match % 20 != 2).select("match_id")
    return stored, ops.merge_with_changes(stored, fresh, matched, as_of=F.lit("2024-03-01").cast("timestamp"))


@query("corridor_refresh", f"""{_REFRESH}, {BUCKETS}
SELECT market, scope_type, scope_value, bucket, sample_size, wins, losses, returns, {SHAPE} FROM corridors""")
def corridor_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors brought up to date by what a merge changed; the SQL builds them anew."""
    stored, merged = _refreshed(spark, sf_dir)
    held = ops.refresh_totals(ops.totals(stored, group=("market",)), merged, group=("market",))
    built = ops.metrics(held, group=("market",))
    return rounded(built.drop("odds_min", "odds_max"))


@query("corridor_changes", f"""{_REFRESH}
SELECT count(*) FILTER (WHERE match_id % 10 <> 2) AS observations_materialized, count(*) FILTER (WHERE match_id % 10 = 1) AS observations_created,
  count(*) FILTER (WHERE match_id % 10 NOT IN (1, 2)) AS observations_updated, count(*) FILTER (WHERE match_id % 20 = 2) AS observations_invalidated FROM obs""")
def corridor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.change_statistics(_refreshed(spark, sf_dir)[1])
