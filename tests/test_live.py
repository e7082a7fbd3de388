"""Alerts, settlement and streams."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import alerts, corridors, live, quality
from oddsloom.sources.strategies import strategies
from oddsloom.streaming import pipeline

T0 = datetime(2026, 1, 1, 12)
AT = lambda minutes: T0 + timedelta(minutes=minutes)


def test_selection_of_alerts(spark):
    rows = [(1, 9, "1x2", 5.0, 0.5, "alert"), (2, 9, "1x2", 5.0, 0.6, "alert"), (3, 9, "total", 7.0, 0.2, "alert"), (4, 9, "total", 9.0, 0.2, "skip"), (5, 8, "1x2", 1.0, 0.1, "alert")]
    df = spark.createDataFrame(rows, "prediction_id long, event_id long, market string, value_percent double, probability double, decision string")
    df = df.withColumns({"strategy": F.lit("s"), "filter_reasons": F.array().cast("array<string>")})
    one = {r.prediction_id: (r.decision, r.filter_reasons) for r in alerts.select_alerts(df).collect()}
    assert one[3][0] == one[5][0] == "alert" and one[2] == ("skip", ["better_selection_available"]) and one[4] == ("skip", [])
    two = {r.prediction_id: r.decision for r in alerts.select_alerts(df, limit=2).collect()}
    assert two == {1: "skip", 2: "alert", 3: "alert", 4: "skip", 5: "alert"}


def test_expiry_and_order_of_pending(spark):
    rows = [(1, "alert", None, AT(5), AT(1)), (2, "alert", None, AT(3), None), (3, "alert", T0, AT(-5), AT(-9)), (4, "alert", None, AT(-1), None), (5, "alert", None, AT(2), AT(0))]
    df = spark.createDataFrame(rows, "signal_id long, decision string, sent_at timestamp, started_at timestamp, expires_at timestamp")
    df = df.withColumns({"filter_reasons": F.array().cast("array<string>"), "alert_key": F.col("signal_id").cast("string")})
    now = F.lit(T0)
    out = {r.signal_id: (r.decision, r.filter_reasons, r.alert_key) for r in alerts.expire(df, now).collect()}
    assert out[4] == ("skip", ["delivery_expired"], None) and out[5][0] == "skip" and out[3] == ("alert", [], "3")
    assert [r.signal_id for r in alerts.pending(df, now).collect()] == [2, 1]
    assert [r.signal_id for r in alerts.pending(df, now, window_minutes=4).collect()] == [2]
    assert [r.signal_id for r in alerts.pending(df, now, limit=1).collect()] == [2]


SIGNALS = (
    "signal_id long, source_event_id long, market string, selection string, l string, frozen_reversed boolean, recorded_reversed boolean, stake string"
)


def signal_rows(spark):
    rows = [(1, 10, "1x2", "P1", None, None, True, "10"), (2, 10, "1x2", "P1", None, False, True, "10"), (3, 10, "corners", "x", None, None, None, "10"),
            (4, 10, "total", "over", "3", None, None, "10"), (5, 10, "total", "over", "2.5", None, None, None), (6, 77, "1x2", "X", None, None, None, "10")]
    df = spark.createDataFrame(rows, SIGNALS)
    return df.select(
        "*", F.lit("alert").alias("decision"), F.lit(T0).alias("sent_at"), F.col("l").cast("decimal(10,3)").alias("line"),
        F.lit("2.5").cast("decimal(12,5)").alias("odds"), F.lit(None).cast("decimal(12,5)").alias("display_odds"),
        F.col("stake").cast("decimal(14,2)").alias("stake_amount"), F.lit(None).cast("decimal(14,2)").alias("suggested_stake"),
    ).drop("l", "stake")


def test_settlement_of_signals(spark):
    results = spark.createDataFrame([(10, 1, 2)], "event_id long, score1 int, score2 int")
    out = live.settle_signals(signal_rows(spark), results, None, now=F.lit(T0))
    got = {r.signal_id: (r.outcome, float(r.profit)) for r in out.collect()}
    assert got == {1: ("win", 15.0), 2: ("loss", -10.0), 3: ("void", 0.0), 4: ("return", 0.0)}
    assert live.settle_signals(signal_rows(spark), results, out, now=F.lit(T0)).count() == 0


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_settlement_stream_books_once(spark, tmp_path):
    schema = "event_id long, score1 int, score2 int"
    source, out, progress = (str(tmp_path / n) for n in ("results", "out", "progress"))
    write(spark, tmp_path, "results", [(10, 1, 2)], schema)
    step = pipeline.settlement_batches(lambda: signal_rows(spark), lambda: F.lit(T0), out)
    for extra in ([], [(77, 1, 1)], [(10, 5, 0)]):
        if extra:
            write(spark, tmp_path, "results", extra, schema)
        pipeline.batch_sink(pipeline.file_stream(spark, source, schema), out, progress, transform=step).awaitTermination()
    got = {(r.signal_id, r.outcome) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "win"), (2, "loss"), (3, "void"), (4, "return"), (6, "win")}


def test_state_follows_quotes_across_batches(spark, tmp_path):
    schema = "contract_event long, selection string, received_at timestamp, snapshot_id long, odds double"
    source, out, progress = (str(tmp_path / n) for n in ("q", "out", "progress"))
    pipeline.use_rocksdb(spark)
    for rows in ([(1, "P1", AT(1), 1, 2.0), (1, "P1", AT(3), 2, 2.4)], [(1, "P1", AT(2), 3, 9.0), (2, "X", AT(1), 4, 3.0)], [(1, "P1", AT(0), 5, 1.5)]):
        write(spark, tmp_path, "q", rows, schema)
        stream = pipeline.file_stream(spark, source, schema)
        pipeline.batch_sink(pipeline.quote_state(stream, ("contract_event", "selection")), out, progress, mode="update").awaitTermination()
    state = {r.contract_event: r for r in pipeline.newest_state(spark.read.parquet(out), ("contract_event", "selection")).collect()}
    assert (state[1].opening.odds, state[1].current.odds, state[1].observations) == (1.5, 2.4, 4)
    assert state[2].current.snapshot_id == 4


def test_quote_without_result_is_emitted_after_the_horizon(spark, tmp_path):
    q, r = "event_id long, received_at timestamp, odds double", "event_id long, observed_at timestamp, score1 int, score2 int"
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    batches = [
        ([(1, AT(0), 2.0), (2, AT(0), 3.0)], [(1, AT(30), 1, 0)]),
        ([(3, AT(5000), 4.0)], [(9, AT(6000), 0, 0)]),
        ([(4, AT(9000), 4.0)], [(9, AT(9000), 0, 0)]),
    ]
    for quotes, results in batches:
        write(spark, tmp_path, "q", quotes, q)
        write(spark, tmp_path, "r", results, r)
        joined = pipeline.quotes_with_results(
            pipeline.file_stream(spark, str(tmp_path / "q"), q), pipeline.file_stream(spark, str(tmp_path / "r"), r),
            result_delay="1 hour", horizon="1 hour",
        )
        pipeline.batch_sink(joined, out, progress).awaitTermination()
    got = {(x.event_id, x.score1) for x in spark.read.parquet(out).collect()}
    assert (1, 1) in got and (2, None) in got and (4, None) not in got


def test_repeated_alert_keys_across_batches(spark, tmp_path):
    schema = "prediction_id long, alert_key string"
    source, out, progress = (str(tmp_path / n) for n in ("a", "out", "progress"))
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        write(spark, tmp_path, "a", rows, schema)
        stream = pipeline.file_stream(spark, source, schema).withColumns(
            {"decision": F.lit("alert"), "filter_reasons": F.array().cast("array<string>")}
        )
        pipeline.batch_sink(stream, out, progress, transform=pipeline.alert_sink(out)).awaitTermination()
    got = {r.prediction_id: r.decision for r in spark.read.parquet(out).collect()}
    assert got == {1: "alert", 2: "skip", 3: "alert", 4: "skip", 5: "alert"}


def test_a_batch_tried_again_keeps_its_rows(spark, tmp_path):
    out = str(tmp_path / "alerts")
    step = pipeline.alert_sink(out)
    schema = "prediction_id long, alert_key string, decision string, filter_reasons array<string>"
    batches = [[(1, "a", "alert", []), (2, "b", "alert", [])], [(3, "b", "alert", []), (4, "c", "alert", [])]]
    for batch_id in (0, 0, 1, 1, 0):
        rows = step(spark.createDataFrame(batches[batch_id], schema), batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        got = {r.prediction_id: r.decision for r in spark.read.parquet(out).collect()}
        assert got[1] == got[2] == "alert" and got.get(3, "skip") == "skip" and got.get(4, "alert") == "alert"
    out = str(tmp_path / "settled")
    step = pipeline.settlement_batches(lambda: signal_rows(spark), lambda: F.lit(T0), out)
    results = spark.createDataFrame([(10, 1, 2)], "event_id long, score1 int, score2 int")
    sizes = []
    for batch_id in (0, 0, 1):
        step(results, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        sizes.append(spark.read.parquet(f"{out}/batch_id={batch_id}").count())
    assert sizes[0] == sizes[1] > 0 and sizes[2] == 0


def test_sessions_close_in_append_mode(spark, tmp_path):
    schema = "player string, started_at timestamp, goals int"
    source, out, progress = (str(tmp_path / n) for n in ("s", "out", "progress"))
    for rows in ([("a", AT(0), 1), ("a", AT(45), 2), ("a", AT(91), 4)], [("b", AT(9000), 1)], [("b", AT(9001), 1)]):
        write(spark, tmp_path, "s", rows, schema)
        stream = pipeline.sessions(pipeline.file_stream(spark, source, schema), ["player"], delay="1 hour")
        pipeline.batch_sink(stream, out, progress).awaitTermination()
    got = {(r.player, r.matches, r.goals) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 2, 3), ("a", 1, 4)}


def test_audit_counts(spark):
    child = spark.createDataFrame([(1, 1, "a"), (2, None, "a"), (3, 9, "b")], "id int, parent_id int, k string")
    parent = spark.createDataFrame([(1,), (1,)], "id int")
    assert quality.orphans(child, "parent_id", parent, "id").count() == 2
    assert quality.orphans(child, "parent_id", parent, "id", optional=True).count() == 1
    assert [r.n for r in quality.duplicate_groups(child, ["k"]).collect()] == [2]
    checks = (quality.Unique("d", "child", ("k",)), quality.Contract("c", "child", "t.id > p.id", (("p", "parent", "parent_id", "p.id"),)))
    report = quality.audit({"child": child, "parent": parent}, checks)
    assert {(r.kind, r.name): r.n for r in report.collect()} == {("rows", "child"): 3, ("rows", "parent"): 2, ("problem", "d"): 1, ("problem", "c"): 0}
    assert not quality.is_healthy(report).first().healthy
    assert quality.is_healthy(quality.audit({"child": child, "parent": parent}, checks[1:])).first().healthy
    assert len(quality.CHECKS) == 46 and len({c.name for c in quality.CHECKS}) == 46


def test_stale_limit_is_strict(spark):
    df = spark.createDataFrame([(1, AT(0)), (2, AT(-2)), (3, T0 - timedelta(seconds=121))], "i int, received_at timestamp")
    assert {r.i for r in pipeline.fresh_only(df, F.lit(T0)).collect()} == {1, 2}


def live_tables(spark):
    """One upcoming event with a corridor-free strategy and a short history."""
    history = spark.createDataFrame(
        [(i, AT(-600 + 30 * i), AT(-590 + 30 * i), "football", "A", "B", 3, i % 2) for i in range(12)],
        "event_id long, started_at timestamp, available_at timestamp, sport string, player1 string, player2 string, score1 int, score2 int",
    )
    matches = spark.createDataFrame(
        [(1, 900, 50, 0.97, False, AT(60), "scheduled", "hist", "football", None, None, "book", "T", "A", "B")],
        "match_id long, source_event_id long, book_event_id long, confidence double, reversed_sides boolean, started_at timestamp, "
        "status string, source string, sport string, game string, family string, bookmaker string, tournament string, player1 string, player2 string",
    )
    nothing = spark.range(0).select(
        F.lit("book").alias("bookmaker"), F.lit("football").alias("sport"), F.lit("").alias("game_key"), F.lit("1x2").alias("market"),
        F.lit("P1").alias("selection"), F.lit(None).cast("decimal(10,3)").alias("line"), F.lit("").alias("family"),
        F.lit("2.0").cast("decimal(12,5)").alias("odds"), F.lit("win").alias("outcome"),
    )
    return {"history": history, "matches": matches, "corridors": corridors.build(nothing)}


def test_signal_stream_sends_the_best_alert_once(spark, tmp_path):
    table = strategies(spark, {"s": {
        "prediction_enabled": True, "alerts_enabled": True, "source": "hist", "model_name": live.RESULT_MODEL, "model_version": "v1",
        "min_samples": 5, "allowed_markets": ["1x2"], "suspicious_edge_percent": 500.0,
    }})
    schema = "book_event_id long, snapshot_id long, market string, selection string, line decimal(10,3), odds decimal(12,5), received_at timestamp"
    source, out, progress = (str(tmp_path / n) for n in ("q", "out", "progress"))
    step = pipeline.signal_batches(lambda: live_tables(spark), table, lambda: F.lit(T0), out)
    batches = [
        [(50, 1, "1x2", "P1", None, Decimal("1.5"), AT(-3)), (50, 2, "1x2", "P1", None, Decimal("2.0"), AT(-1)), (50, 3, "1x2", "X", None, Decimal("9.0"), AT(-1)),
         (50, 4, "1x2", "P2", None, Decimal("3.0"), AT(-5)), (51, 5, "1x2", "P1", None, Decimal("2.0"), AT(-1))],
        [(50, 6, "1x2", "P1", None, Decimal("2.1"), AT(0)), (50, 7, "1x2", "P1", None, Decimal("2.1"), AT(1))],
    ]
    for rows in batches:
        write(spark, tmp_path, "q", rows, schema)
        pipeline.batch_sink(pipeline.file_stream(spark, source, schema), out, progress, transform=step).awaitTermination()
    got = {r.snapshot_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {2, 3, 4, 6}
    assert got[2].decision == "alert" and got[2].alert_key == "s:50:1x2:P1:-" and got[2].sample_size == 12
    assert got[2].expires_at == AT(1) and float(got[2].stake_percent) == 1.5
    assert "stale_odds" in got[4].filter_reasons and "below_minimum_odds" in got[3].filter_reasons
    assert got[6].decision == "skip" and got[6].filter_reasons == ["duplicate_alert"]


if __name__ == "__main__":
    pytest.main([__file__])


def test_snapshots_collected_twice_are_stored_once(spark, tmp_path):
    """Readable, unreadable and empty payloads; every batch is tried again under its old id."""
    good = (
        '{"sports": [{"id": 1, "name": "Football", "alias": "football"}, {"id": 11, "parentId": 1, "name": "FC26. United Esports Leagues. 2x3 min. Czech"}],'
        ' "events": [{"id": 5, "level": 1, "sportId": 11, "team1": "A (x)", "team2": "B (y)", "startTime": 1767225600, "place": "line"},'
        ' {"id": 6, "level": 1, "sportId": 11, "team1": "A (x)", "startTime": 1767225600}],'
        ' "customFactors": [{"e": 5, "factors": [{"f": 921, "v": 1.5}, {"f": 922, "v": 1.0}]}]}'
    )
    bodies = [good, "{", "", None, '{"events": []}', good]
    landed = str(tmp_path / "landed")
    for i, body in enumerate(bodies):
        spark.createDataFrame([(i, T0 + timedelta(days=i), "book", body)], "payload_id long, received_at timestamp, provider string, body string").coalesce(1).write.mode(
            "append").parquet(landed)
    schema = spark.read.parquet(landed).schema
    for attempt in range(2):
        stream = pipeline.file_stream(spark, landed, schema, max_files=4)
        pipeline.collect_snapshots(stream, str(tmp_path / "out"), str(tmp_path / f"progress{attempt}")).awaitTermination()

    def stored(name):
        return spark.read.parquet(str(tmp_path / "out" / name))

    assert stored("archive").count() == 6 and stored("archive").select("batch_id").distinct().count() == 2
    runs = {r.payload_id: (r.received, r.parsed, r.rejected, r.status) for r in stored("runs").collect()}
    assert runs == {0: (2, 1, 1, "partial"), 5: (2, 1, 1, "partial"), **{i: (0, 0, 1, "partial") for i in (1, 2, 3, 4)}}
    assert sorted((r.payload_id, r.event_id, float(r.odds)) for r in stored("quotes").collect()) == [(0, "5", 1.5), (5, "5", 1.5)]
    assert stored("rejects").count() == 6
    day = stored("quotes").where(F.col("received_date") == F.lit((T0 + timedelta(days=5)).date()))
    assert day.count() == 1 and "PartitionFilters: [isnotnull(received_date" in day._jdf.queryExecution().executedPlan().toString()


def test_sent_keys_are_state_that_ends(spark, tmp_path):
    """Batches of one day each: repeats are held back, late alerts too, and keys leave the state after their day."""
    rows, n = [], 0
    for day in range(6):
        for key in range(20):
            for minute in (0, 5, 60 * 7):
                n += 1
                at = T0 + timedelta(days=day, minutes=minute + key)
                rows.append((n, at, T0 + timedelta(days=day, hours=6), f"{day}:{key}", "alert" if (key + minute) % 7 else "skip", []))
    schema = "signal_id long, created_at timestamp, expires_at timestamp, alert_key string, decision string, filter_reasons array<string>"
    landed = str(tmp_path / "landed")
    for day in range(6):
        write_rows = [row for row in rows if row[3].startswith(f"{day}:")]
        spark.createDataFrame(write_rows, schema).coalesce(1).write.mode("append").parquet(landed)
    pipeline.use_rocksdb(spark)
    stream = pipeline.file_stream(spark, landed, spark.read.parquet(landed).schema, max_files=1)
    out = str(tmp_path / "out")
    query = pipeline.batch_sink(pipeline.delivered_once(stream, life="7 hours"), out, str(tmp_path / "progress"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    sent = spark.read.parquet(out)
    after = {r.signal_id: (r.decision, list(r.filter_reasons)) for r in pipeline.with_deliveries(spark.createDataFrame(rows, schema), sent).collect()}
    want, seen = {}, set()
    for number, at, until, key, decision, _ in rows:
        if decision == "skip":
            want[number] = ("skip", [])
        elif at >= until:
            want[number] = ("skip", ["delivery_expired"])
        elif key in seen:
            want[number] = ("skip", ["duplicate_alert"])
        else:
            seen.add(key)
            want[number] = ("alert", [])
    by_key = lambda got: sorted((rows[i - 1][3], rows[i - 1][1] >= rows[i - 1][2], *map(str, value)) for i, value in got.items())
    assert by_key(after) == by_key(want)
    assert max(held) <= 60 < len(seen)
