"""Settlement, staking, simulation and corridors against known numbers."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import odds, poisson, settlement
from oddsloom.operators import corridors, prefix, quotes, simulate
from oddsloom.sources.strategies import strategies

T0 = datetime(2026, 1, 1, 12)


def values(df, *names):
    return [tuple(row[name] for name in names) for row in df.collect()]


def test_notation_table(spark):
    cases = [
        ("P1", 2, 1, "win"), ("P1", 1, 1, "loss"), ("П2", 0, 1, "win"), ("X", 1, 1, "win"), ("Х", 1, 0, "loss"),
        ("1X", 1, 1, "win"), ("X2", 2, 1, "loss"), ("12", 1, 1, "loss"), ("F1(-1)", 2, 1, "return"),
        ("F2(+1.5)", 2, 1, "win"), ("Ф1(-1,5)", 2, 1, "loss"), ("TB(2.5)", 2, 1, "win"), ("TM(3)", 2, 1, "return"),
        ("ТМ 2.5", 1, 1, "win"), ("tb2", 0, 1, "loss"), ("F1(0.25)", 1, 0, None), ("corner", 1, 0, None),
        ("P1", -1, 0, None),
    ]
    df = spark.createDataFrame(cases, "s string, a int, b int, want string")
    out = df.withColumn("got", settlement.notation_outcome(F.col("s"), F.col("a"), F.col("b")))
    assert all(row.got == row.want for row in out.collect())


def test_structured_contracts_and_reasons(spark):
    cases = [
        ("over", "total", "2.5", 2, 1, "win", None), ("ТБ(2.5)", "total", "2.5", 1, 1, "loss", None),
        ("TB(3.5)", "total", "2.5", 1, 1, None, "unsupported_selection"),
        ("under", "total", None, 1, 1, None, "missing_line"), ("under", "total", "3", 2, 1, "return", None),
        ("P1", "1X2 ", None, 2, 1, "win", None), ("F1(-1)", "handicap", "-1", 2, 1, "return", None),
        ("F2(+0.5)", "handicap", "0.5", 1, 1, "win", None), ("F1", "handicap", "0.25", 1, 1, None, "quarter_line"),
        ("yes", "btts", None, 1, 1, None, "unsupported_market"), ("P1", "1x2", None, None, 1, None, "missing_score"),
        ("P9", "1x2", None, 1, 1, None, "unsupported_selection"),
    ]
    df = spark.createDataFrame(cases, "selection string, market string, l string, score1 int, score2 int, want string, why string")
    out = settlement.settle(df.withColumn("line", F.col("l").cast("decimal(10,3)")))
    for row in out.collect():
        assert (row.outcome, row.error_reason) == (row.want, row.why), row


def test_payouts(spark):
    df = spark.createDataFrame([("win",), ("loss",), ("return",), ("void",)], "outcome string")
    paid = settlement.with_payout(df.withColumns({"stake": F.lit(10).cast("decimal(14,2)"), "odds": F.lit("2.5").cast("decimal(12,5)")}))
    assert [float(row.profit) for row in paid.collect()] == [15.0, -10.0, 0.0, 0.0]


def test_staking_numbers(spark):
    df = spark.createDataFrame([(0.9, 0.0), (1.154, 1.54), (1.235, 2.35), (1.364, 3.0), (2.0, 3.0)], "v double, want double")
    for row in df.withColumn("got", odds.observed_multiplier(F.col("v"))).collect():
        assert row.got == pytest.approx(row.want)
    one = spark.range(1).select(
        odds.kelly_fraction(F.lit(0.6), F.lit(2.0)).alias("k"),
        odds.kelly_stake(F.lit(1000.0), F.lit(0.6), F.lit(2.0), F.lit(0.25), F.lit(40.0)).alias("s"),
        odds.kelly_fraction(F.lit(0.2), F.lit(2.0)).alias("none"),
        odds.fair_odds(F.lit(1.2)).alias("bad"),
    ).first()
    assert one.k == pytest.approx(0.2) and one.s == 40.0 and one.none == 0.0 and one.bad is None


def test_poisson_closed_forms(spark):
    df = spark.createDataFrame([(2.0, 2.0, "over"), (2.0, 2.0, "under"), (0.0, 1.5, "under")], "rate double, line double, selection string")
    rows = poisson.with_total_probabilities(df).collect()
    push = math.exp(-2) * 2
    assert rows[0].total_push == pytest.approx(push)
    assert rows[0].total_win + rows[0].total_loss + rows[0].total_push == pytest.approx(1)
    assert rows[0].total_conditional + rows[1].total_conditional == pytest.approx(1)
    assert rows[2].total_win == 1.0
    grid = poisson.with_outcome_probabilities(
        spark.createDataFrame([(1.3, 0.7), (0.0, 0.0), (3.0, 3.0)], "rate1 double, rate2 double")
    ).collect()
    for row in grid:
        assert row.poisson_p1 + row.poisson_px + row.poisson_p2 == pytest.approx(1)
    pmf = [[math.exp(-r) * r**k / math.factorial(k) for k in range(21)] for r in (1.3, 0.7)]
    total = sum(a * b for a in pmf[0] for b in pmf[1])
    win = sum(pmf[0][i] * pmf[1][j] for i in range(21) for j in range(i)) / total
    assert grid[0].poisson_p1 == pytest.approx(win) and grid[1].poisson_px == 1.0


def opportunities(spark, rows, definition):
    base = spark.createDataFrame(
        rows, "event_id long, minute int, probability double, odds double, score1 int, score2 int"
    )
    at = F.lit(T0) + F.make_interval(mins=F.col("minute"))
    table = strategies(spark, {"s": definition})
    wide = base.select(
        "event_id", at.alias("decision_at"), at.alias("feature_cutoff_at"), at.alias("odds_received_at"),
        (at + F.expr("INTERVAL 1 HOUR")).alias("event_started_at"), F.col("event_id").alias("odds_snapshot_id"),
        "probability", F.col("odds").cast("decimal(12,5)").alias("odds"), F.lit("1x2").alias("market"),
        F.lit("P1").alias("selection"), F.lit(None).cast("decimal(10,3)").alias("line"), F.lit("T").alias("tournament"),
        F.lit(50).alias("sample_size"), F.lit(9).alias("h2h_samples"), F.lit(0.99).alias("match_confidence"),
        "score1", "score2", F.lit("s").alias("strategy"),
    )
    return wide.join(table, "strategy")


def random_bets(seed, count):
    rng = random.Random(seed)
    return [
        (i, rng.randrange(600), rng.uniform(0.3, 0.9), round(rng.uniform(1.3, 3.0), 2), rng.randrange(3), rng.randrange(3))
        for i in range(count)
    ]


def fold(rows, share, cap):
    bankroll, path = 100.0, {}
    for event, minute, p, price, a, b in sorted(rows, key=lambda r: (r[1], r[0])):
        kelly = max(0.0, ((price - 1) * p - (1 - p)) / (price - 1))
        if not 0 < kelly or price * p < 1 or price < 1 / p:
            continue
        stake = bankroll * share * kelly if cap is None else min(bankroll * share * kelly, cap)
        path[event] = (bankroll, stake)
        bankroll += stake * (price - 1) if a > b else -stake
    return path


def test_kelly_paths_follow_the_sequential_bankroll(spark):
    cap = None
    rows = random_bets(1, 200)
    definition = {"stake_mode": "kelly_0_25", "max_stake": cap, "suspicious_edge_percent": 500.0}
    opps = opportunities(spark, rows, definition)
    run = simulate.simulate(opps, bucket_seconds=900)
    got = {r.event_id: (r.bankroll_before, r.stake) for r in run.where("decision = 'alert'").collect()}
    wanted = fold(rows, 0.25, cap)
    assert got.keys() == wanted.keys()
    for event, (bankroll, stake) in wanted.items():
        assert got[event][0] == pytest.approx(bankroll, rel=1e-9)
        assert got[event][1] == pytest.approx(stake, rel=1e-9)


def test_run_metrics_match_a_sequential_pass(spark):
    rows = random_bets(2, 300)
    opps = opportunities(spark, rows, {"stake_mode": "fixed", "suspicious_edge_percent": 500.0})
    run = simulate.simulate(opps, bucket_seconds=600)
    row = simulate.run_metrics(run, bucket_seconds=600).first()
    cumulative = peak = fall = streak = longest = 0
    for r in run.where("decision = 'alert'").orderBy("decision_at", "event_id").collect():
        cumulative += r.profit
        peak = max(peak, cumulative)
        fall = max(fall, peak - cumulative)
        streak = streak + 1 if r.outcome == "loss" else 0 if r.outcome == "win" else streak
        longest = max(longest, streak)
    assert row.max_drawdown == pytest.approx(fall) and row.longest_losing_streak == longest
    assert row.profit == pytest.approx(cumulative) and row.predictions == 300


def test_flat_run_and_reasons(spark):
    rows = [(1, 0, 0.6, 2.0, 2, 1), (2, 5, 0.4, 2.0, 0, 1)]
    run = simulate.simulate(opportunities(spark, rows, {"base_stake": 10.0})).orderBy("event_id").collect()
    assert (run[0].decision, run[0].profit, run[0].bankroll_before) == ("alert", 10.0, 100.0)
    assert run[1].decision == "skip" and run[1].filter_reasons == ["below_minimum_value", "below_minimum_odds"]
    capped = opportunities(spark, rows, {"stake_mode": "kelly_0_1", "max_stake": 5.0})
    with pytest.raises(Exception, match="cannot be simulated"):
        simulate.simulate(capped).collect()


def test_clock_order_is_enforced(spark):
    good = opportunities(spark, [(1, 0, 0.6, 2.0, 2, 1)], {})
    assert simulate.require_order(good).count() == 1
    bad = good.withColumn("odds_received_at", F.col("decision_at") + F.expr("INTERVAL 1 SECOND"))
    assert simulate.temporal_violations(bad).first().violation == "quote came after the decision"
    with pytest.raises(Exception, match="came after the decision"):
        simulate.require_order(bad).collect()


def test_running_sums_do_not_depend_on_the_bucket(spark):
    rng = random.Random(5)
    rows = [(i, T0 + timedelta(seconds=rng.randrange(5000)), float(rng.randrange(-5, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at timestamp, v double").withColumn("run", F.col("id") % 2)
    options = dict(run=["run"], order=["at", "id"], at="at", values={"before": F.col("v")})
    one = values(prefix.running_sums(df, bucket_seconds=60, **options).orderBy("id"), "before")
    two = values(prefix.running_sums(df, bucket_seconds=100000, **options).orderBy("id"), "before")
    assert one == two


def test_strategy_ranges(spark):
    with pytest.raises(ValueError, match="min_odds"):
        strategies(spark, {"x": {"min_odds": 5.0, "max_odds": 2.0}})
    with pytest.raises(ValueError, match="alerts_enabled"):
        strategies(spark, {"x": {"alerts_enabled": True}})
    with pytest.raises(ValueError, match="unknown parameters"):
        strategies(spark, {"x": {"edge": 1}})


def test_closing_quote_and_movement(spark):
    rows = [
        (1, 0, "P1", "2.0", 1), (1, 10, "P1", "2.2", 2), (1, 60, "P1", "9.0", 3), (2, 50, "X", "3.0", 4), (2, 50, "X", "3.5", 5),
    ]
    df = spark.createDataFrame(rows, "contract_event int, minute int, selection string, o string, snapshot_id long").select(
        "contract_event", F.lit("1x2").alias("market"), "selection", F.lit(None).cast("decimal(10,3)").alias("line"),
        F.col("o").cast("decimal(12,5)").alias("odds"), (F.lit(T0) + F.make_interval(mins=F.col("minute"))).alias("received_at"),
        (F.lit(T0) + F.expr("INTERVAL 60 MINUTES")).alias("kickoff"), "snapshot_id",
    )
    closing = values(quotes.closing_quotes(df).orderBy("contract_event"), "snapshot_id", "odds")
    assert closing == [(2, Decimal("2.20000")), (5, Decimal("3.50000"))]
    assert values(quotes.closing_quotes(df, max_age_seconds=900), "snapshot_id") == [(5,)]
    move = quotes.odds_movement(df).where("contract_event = 1").first()
    assert (move.opening_odds, move.current_odds, move.observations) == (2.0, 2.2, 2)
    assert move.change_percent == pytest.approx(10.0) and move.seconds_since_open == 600


def test_margin_removal(spark):
    df = spark.createDataFrame([("P1", "2.0"), ("X", "4.0"), ("P2", "4.0")], "selection string, o string").select(
        F.lit(1).alias("m"), "selection", F.col("o").cast("decimal(12,5)").alias("odds")
    )
    fair = dict(values(quotes.implied_probabilities(df, ["m"]), "selection", "normalized_probability"))
    assert fair == {"P1": 0.5, "X": 0.25, "P2": 0.25}
    assert quotes.implied_probabilities(df.where("selection = 'X'"), ["m"]).count() == 0


def observations(spark, count):
    df = spark.range(count)
    return df.select(
        F.lit("b").alias("bookmaker"), F.lit("football").alias("sport"), F.lit("").alias("game_key"),
        F.lit("1x2").alias("market"), F.lit("P1").alias("selection"), F.lit(None).cast("decimal(10,3)").alias("line"),
        F.when(F.col("id") % 2 == 0, "cup").otherwise("").alias("family"),
        F.lit("1.75").cast("decimal(12,5)").alias("odds"),
        F.when(F.col("id") % 5 < 3, "win").when(F.col("id") % 5 == 3, "return").otherwise("loss").alias("outcome"),
    )


def test_corridor_numbers_lookup_and_publish(spark):
    built = corridors.build(observations(spark, 100))
    rows = {row.scope_type: row for row in built.collect()}
    whole = rows["global"]
    assert (whole.sample_size, whole.wins, whole.returns, whole.losses) == (100, 60, 20, 20)
    assert (whole.odds_min, whole.odds_max) == (Decimal("1.7500"), Decimal("2.0000"))
    assert whole.roi_percent == pytest.approx(100 * (60 * 0.75 - 20) / 100)
    assert whole.confidence == pytest.approx(round(1 - 3.92 * math.sqrt(0.24 / 100), 4))
    probe = observations(spark, 2).withColumns({"probe_id": F.monotonically_increasing_id(), "need": F.lit(60)})
    found = corridors.lookup(probe, built, probe_id="probe_id")
    assert {r.family: r.corridor_scope_type for r in found.collect()} == {"cup": "tournament_family", "": "global"}
    deep = corridors.lookup(probe, built, probe_id="probe_id", min_samples="need")
    assert {r.corridor_scope_type for r in deep.collect()} == {"global"}
    now, later = F.lit(T0), F.lit(T0 + timedelta(days=1))
    key = [*corridors.GROUP, "scope_type", "scope_value", "bucket"]
    empty = built.withColumns({"as_of": now, "is_active": F.lit(True), "retired_at": F.lit(None).cast("timestamp")}).limit(0)
    first = corridors.publish(empty, built, as_of=now, key=key)
    second = corridors.publish(first, built.where("scope_type = 'global'"), as_of=later, key=key)
    assert {(r.scope_type, r.is_active) for r in second.collect()} == {("global", True), ("tournament_family", False)}
    with pytest.raises(Exception, match="backwards"):
        corridors.publish(second, built, as_of=now, key=key).collect()


def test_observations_are_built_once_and_kept(spark):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    matches = spark.createDataFrame([(1, 10, 20, "matched", True), (2, 11, 21, "ambiguous", False)],
                                    "match_id long, source_event_id long, book_event_id long, status string, reversed_sides boolean")
    sources = spark.createDataFrame([(10, "history"), (11, "history")], "event_id long, source_type string")
    books = spark.createDataFrame([(20, at(0), "football", None, "cup", "bookmaker", "b"), (21, at(0), "football", None, None, "bookmaker", "b")],
                                  "event_id long, started_at timestamp, sport string, game string, family string, source_type string, bookmaker string")
    results = spark.createDataFrame([(10, 2, 1, at(30), None, None)],
                                    "event_id long, score1 int, score2 int, observed_at timestamp, source_updated_at timestamp, settled_at timestamp")
    rows = [(20, 1, "1x2", "P1", None, "2.0", -10), (20, 2, "1x2", "P1", None, "2.5", -5), (20, 3, "1x2", "P1", None, "9.0", 1),
            (20, 4, "total", "TM(3)", "3", "1.9", -5), (20, 5, "1x2", "X", None, "4.0", -50), (21, 6, "1x2", "X", None, "4.0", -5)]
    quoted = spark.createDataFrame([(e, s, m, x, l, o, at(t)) for e, s, m, x, l, o, t in rows],
                                   "book_event_id long, snapshot_id long, market string, selection string, l string, o string, received_at timestamp")
    quoted = quoted.select("*", F.col("l").cast("decimal(10,3)").alias("line"), F.col("o").cast("decimal(12,5)").alias("odds")).drop("l", "o")
    seen = corridors.closing_observations(matches, sources, books, results, quoted, as_of=F.lit(at(60)))
    got = {(r.selection, r.snapshot_id, r.outcome) for r in seen.collect()}
    assert got == {("P1", 2, "loss"), ("under", 4, "return")}
    assert corridors.closing_observations(matches, sources, books, results, quoted, as_of=F.lit(at(20))).count() == 0
    stored = seen.withColumns({"is_active": F.lit(True), "created_at": F.lit(at(60)), "invalidated_at": F.lit(None).cast("timestamp")})
    again = corridors.merge_observations(stored, seen.where("selection = 'P1'"), matches.limit(0), as_of=F.lit(at(90)))
    assert {(r.selection, r.is_active, r.created_at) for r in again.collect()} == {("P1", True, at(60)), ("under", False, at(60))}


def test_strategies_are_sent_to_the_opportunities(spark, tmp_path):
    """A shuffle by strategy would make one task a strategy, which grows with the input."""
    from oddsloom.plans import betting

    rows = [(i, T0 + timedelta(minutes=i), i % 3, "view", 20.0 + i, '{"k": 4}') for i in range(4)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    table.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bets = betting.strategy_bets(spark, str(tmp_path), betting.STRATEGIES)
        plan = bets._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "hashpartitioning(strategy" not in plan
        assert bets.count() == 4 * len(betting.STRATEGIES)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
