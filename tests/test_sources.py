"""Payload parsing on small payloads of each source, ledger, upserts, files."""

import json
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from oddsloom.functions import clock
from oddsloom.operators import upsert
from oddsloom.session import shared_dir
from oddsloom.sources import book_catalog, files, history, ledger, raw

T0 = datetime(2026, 8, 17, 12)


def payload(spark, body, **extra):
    text = body if isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([(1, T0, text)], "payload_id long, received_at timestamp, body string")
    return df.withColumns({name: F.lit(json.dumps(value)) for name, value in extra.items()})


CATALOG = {
    "packetVersion": 77,
    "sports": [
        {"id": 1, "kind": "sport", "name": "Football", "alias": "football"},
        {"id": 2, "kind": "sport", "name": "Hockey", "alias": "hockey"},
        {"id": 61, "parentId": 1, "name": "United Esports Leagues, FC 26, 2×5, Чехия"},
        {"id": 62, "parentId": 2, "name": "ESportsBattle NHL26 4х5"},
        {"id": 63, "parentId": 1, "name": "Regional Cup"},
    ],
    "events": [
        {"id": 7300, "level": 1, "sportId": 61, "team1": "Uruguay (Kestrel)", "team2": "Norway (Marten)", "startTime": 1790003700, "place": "line"},
        {"id": 7311, "parentId": 7300, "level": 2, "sportId": 61, "name": "half", "startTime": 1790003700},
        {"id": 7322, "level": 1, "sportId": 62, "team1": "Solo Heron", "team2": "Lynx (moss)", "startTime": 1790009160, "place": "live"},
        {"id": 7333, "level": 1, "sportId": 63, "team1": "A", "team2": "B", "startTime": 1},
        {"id": 7344, "level": 1, "sportId": 61, "team1": "A", "startTime": 1},
        {"id": 7355, "level": 1, "sportId": 61, "team1": "A", "team2": "B"},
    ],
    "customFactors": [
        {"e": 7300, "factors": [{"f": 921, "v": 4.15}, {"f": 922, "v": 1}, {"f": 930, "v": 1.87, "p": 350, "pt": "3.5"},
                               {"f": 927, "v": 1.95, "p": -250}, {"f": 931, "v": 1.5, "pt": "x"}, {"f": 5, "v": 1.2}]},
        {"e": 7322, "factors": [{"f": 923, "v": 2.65}]},
        {"e": 7333, "factors": [{"f": 921, "v": 2.1}]},
        {"e": 7344, "factors": [{"f": 921, "v": 2.1}]},
    ],
}


def test_book_catalog(spark):
    out = book_catalog.parse(payload(spark, CATALOG))
    tournaments = {r.tournament_id: r for r in out["tournaments"].collect()}
    assert set(tournaments) == {"61", "62"}
    ten = tournaments["61"]
    assert (ten.sport, ten.game, ten.format, ten.family, ten.country) == ("football", "FC26", "2x5", "uel", "CZ")
    assert (tournaments["62"].family, tournaments["62"].format) == ("esb", "4x5")
    events = {r.event_id: r for r in out["events"].collect()}
    assert set(events) == {"7300", "7322"}
    assert events["7300"].internal_id == "uel_ef_7300" and events["7300"].player_name1 == "Kestrel"
    assert events["7300"].status == "scheduled" and events["7322"].status == "live" and events["7322"].player_name1 is None
    assert events["7300"].started_at == datetime(2026, 9, 21, 15, 15)
    quotes = {(r.event_id, r.factor_id): (r.market, r.selection, r.odds, r.line) for r in out["quotes"].collect()}
    assert quotes == {
        ("7300", "921"): ("1x2", "P1", Decimal("4.15000"), None),
        ("7300", "930"): ("total", "over", Decimal("1.87000"), Decimal("3.500")),
        ("7300", "927"): ("handicap", "F1(-2.5)", Decimal("1.95000"), Decimal("-2.500")),
        ("7300", "931"): ("unmapped_factor", "factor:931", Decimal("1.50000"), None),
        ("7300", "5"): ("unmapped_factor", "factor:5", Decimal("1.20000"), None),
        ("7322", "923"): ("1x2", "P2", Decimal("2.65000"), None),
    }
    reasons = {r.reject_reason for r in out["rejects"].collect()}
    assert reasons == {"invalid core fields for event 7344", "missing startTime for event 7355"}


def test_broken_payload_is_a_ledger_row(spark):
    out = book_catalog.parse(payload(spark, "{not json").unionByName(payload(spark, CATALOG)))
    assert out["events"].count() == 2
    run = ledger.runs(out["items"], ["payload_id"]).first()
    assert (run.received, run.parsed, run.rejected, run.status) == (5, 2, 3, "partial")
    assert run.last_error.startswith("payload requires sports and events arrays; invalid core")


def test_ledger_shows_twenty_reasons(spark):
    items = spark.range(50).select(F.lit("s").alias("source"), F.col("id").alias("position"), F.concat(F.lit("bad"), "id").alias("reject_reason"))
    run = ledger.runs(items, ["source"]).first()
    assert run.rejected == 50 and run.last_error.split("; ") == [f"bad{i}" for i in range(20)]
    good, bad = ledger.split(items.withColumn("reject_reason", F.when(F.col("position") > 9, F.col("reject_reason"))))
    assert good.count() == 10 and bad.count() == 40 and "reject_reason" not in good.columns


def side(pid, nick, score):
    return {"id": pid, "nickname": nick, "score": score, "team": {"id": 7, "token": "Чили", "token_international": "Chile"}}


def test_unreadable_history_payloads_are_rejected(spark):
    broken = payload(spark, "{no").unionByName(payload(spark, ""))
    headed = broken.withColumn("tournament", F.lit("{no"))
    outs = [
        history.parse_a_page(broken), history.parse_a_matches(headed), history.parse_b_page(broken, items_per_page=20),
        history.parse_b_games(broken, zone="Europe/Prague", sport="efootball"), history.parse_c_schedule(broken, api_sport="nba"),
    ]
    for out in outs:
        assert out["rejects"].count() == 2 == out["items"].where("reject_reason is not null").count()
        assert all(r.reject_reason.endswith("payload cannot be read") for r in out["rejects"].collect())


def test_history_a(spark):
    page = {"totalPages": 4, "tournaments": [{"id": 1, "status_id": 3, "token": "Л", "token_international": " Liga "}, {"id": 2, "status_id": 4}]}
    out = history.parse_a_page(payload(spark, page))
    assert [(r.tournament_id, r.name) for r in out["rows"].collect()] == [("1", "Liga")]
    assert out["rejects"].first().reject_reason == "tournament[1] has invalid core fields"
    assert out["pages"].first().total_pages == 4
    games = [
        {"id": 5, "date": "2026-05-03T21:40:00+03:00", "status_id": 3, "participant1": side(1, " a ", 7), "participant2": side(2, "b", 7)},
        {"id": 6, "date": "2026-05-03T21:40:00", "status_id": 3, "participant1": side(1, "a", 2), "participant2": side(2, "b", 2)},
        {"id": 7, "date": "2026-05-03T21:40:00Z", "status_id": 4, "participant1": side(1, "a", None), "participant2": side(2, "b", 0)},
    ]
    head = {"id": 9, "status_id": 3, "token": "T"}
    out = history.parse_a_matches(payload(spark, games, tournament=head))
    events = {r.event_id: r for r in out["events"].collect()}
    assert set(events) == {"5", "7"} and events["5"].started_at == datetime(2026, 5, 3, 18, 40)
    assert (events["5"].status, events["7"].status) == ("finished", "unknown")
    assert events["5"].player_key1 == "a" and events["5"].team_name1 == "Chile"
    result = out["results"].first()
    assert (result.winner, result.is_draw, result.total, result.observed_at, result.settled_at) == ("X", True, 14, T0, None)


def test_history_b(spark):
    page = {"items": [{"id": "1", "id_sl": "2", "title_ru": "Тур", "title_en": " ", "country": "CZ", "state": "Finished"}, {"id": "3"}], "total_items": 41}
    out = history.parse_b_page(payload(spark, page), items_per_page=20)
    assert [(r.name, r.state) for r in out["rows"].collect()] == [("Тур", "finished")]
    assert out["pages"].first().total_pages == 3
    base = {"player_1_id_sl": "1", "player_1_title_en": "P", "player_2_id_sl": 2, "player_2_title_en": "Q", "team_1_id_sl": "10",
            "team_1_title_ru": "Чили", "team_1_title_en": "Chile", "team_2_id_sl": "20", "team_2_title_en": "Ghana"}
    games = [
        base | {"id_sl": "100", "date_time": "2026-03-11 19:05:00", "score_team1": "6", "score_team2": "4", "state": "finished", "updated_at": "2026-03-11 17:58:12"},
        base | {"id_sl": "101", "date_time": "2026-03-11 19:20:00", "score_team1": "-1", "score_team2": "x", "state": "Paused", "updated_at": "2026-03-11 17:30:00"},
        base | {"id_sl": "102", "date_time": "11.03.2026", "state": "finished"},
    ]
    out = history.parse_b_games(payload(spark, {"tour_blocks": {"games": games}}), zone="Europe/Prague", sport="efootball")
    events = {r.event_id: r for r in out["events"].collect()}
    assert events["100"].started_at == datetime(2026, 3, 11, 18, 5) and events["100"].source_updated_at is None
    assert events["101"].status == "unknown" and events["101"].score1 is None
    assert events["100"].team_alternate1 == "Чили" and events["100"].player_key2 == "2"
    assert out["rejects"].first().reject_reason == "game[2] has invalid core fields"
    assert out["results"].first().winner == "P1"


def test_history_c(spark):
    base = {"isCancelled": False, "teamAName": "Wolves", "teamBName": "Ravens", "participantAName": "dex", "participantBName": "ivo", "streamName": "north", "tournamentName": " H2H  League "}
    rows = [
        base | {"externalId": "1", "startDate": "2026-06-02T04:10:00Z", "matchStatus": "MATCH_ENDED", "teamAScore": 5, "teamBScore": 2},
        base | {"externalId": "2", "startDate": "2026-06-02T05:45:00Z", "matchStatus": None, "teamAScore": None, "teamBScore": None},
        base | {"externalId": "3", "startDate": "2026-06-02T05:45:00", "matchStatus": None},
        None,
        base | {"externalId": "5", "startDate": "2026-06-02T05:45:00Z", "isCancelled": True},
        base | {"externalId": "6", "startDate": "2026-06-02T05:45:00Z", "matchStatus": "MATCH_ENDED", "teamAScore": -1, "teamBScore": 3},
    ]
    out = history.parse_c_schedule(payload(spark, rows), api_sport="nba")
    got = {r.event_id: r.status for r in out["events"].collect()}
    assert got == {"1": "finished", "2": "scheduled", "5": "cancelled", "6": "unknown"}
    assert {r.reject_reason for r in out["rejects"].collect()} == {"match[2] has invalid core fields", "match[3] is not an object"}
    import hashlib

    digest = hashlib.sha256(b"h2h league").hexdigest()[:16]
    assert out["tournaments"].first().tournament_id == f"nba:{digest}"
    assert out["events"].first().sport == "basketball" and out["results"].first().winner == "P1"


def test_archive_and_dedup(spark, tmp_path):
    rows = [("p", "k", {"Cookie": "x", "A": "b"}, T0, bytearray(b"one")), ("p", "k", {"A": "c"}, T0 + timedelta(1), bytearray(b"one"))]
    df = spark.createDataFrame(rows, "provider string, kind string, headers map<string,string>, received_at timestamp, body binary")
    raw.append(df, str(tmp_path / "archive"))
    raw.append(df.limit(1), str(tmp_path / "archive"))
    stored = spark.read.parquet(str(tmp_path / "archive"))
    assert stored.count() == 3 and stored.where("received_date = '2026-08-18'").count() == 1
    assert all("Cookie" not in r.headers for r in stored.collect())
    first = raw.first_copies(df).first()
    assert first.copies == 2 and first.received_at == T0 and first.size_bytes == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_bytes(b"{}")
    read = raw.read_files(spark, str(tmp_path / "in"), "p", "k").select(raw.text(F.col("body")).alias("t")).first()
    assert read.t == "{}"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", T0, T0, 1), (2, "b", T0, T0, 1)], "event_id long, v string, received_at timestamp, observed_at timestamp, payload_id long")
    later = T0 + timedelta(hours=1)
    new = spark.createDataFrame([(1, "c", later, later, 2)], old.schema)
    latest = upsert.upsert_latest(old, new, keys=["event_id"], order=["received_at", "payload_id"])
    assert {r.event_id: r.v for r in latest.collect()} == {1: "c", 2: "b"}
    merged = {r.event_id: (r.v, r.observed_at) for r in upsert.upsert_results(old, new).collect()}
    assert merged == {1: ("c", T0), 2: ("b", T0)}
    again = upsert.upsert_results(upsert.upsert_results(old, new), new)
    assert {r.event_id: (r.v, r.observed_at) for r in again.collect()} == merged


def test_files(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"id": "x", "odds": 2.15, "v": 1.235, "mo": 1.74}, {"id": "y"}]))
    rows = files.read_observations(spark, str(tmp_path / "o.json"))
    assert [(r.id, r.odds) for r in rows.orderBy("id").collect()] == [("x", 2.15), ("y", None)]
    files.write_csv(rows.select("id", F.struct("odds").alias("s")), str(tmp_path / "csv"))
    files.write_json(rows, str(tmp_path / "json"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_clocks(spark):
    texts = ["2026-01-01T10:00:00Z", "2026-01-01T10:00:00+0200", "2026-01-01T10:00:00", "2026-01-01", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(clock.from_iso_with_offset(F.col("t")).alias("c")).collect()]
    assert got == [datetime(2026, 1, 1, 10), datetime(2026, 1, 1, 8), None, None, None]
    row = spark.range(1).select(
        clock.earliest_available(F.lit(None).cast("timestamp"), F.lit(T0), F.lit(T0 - timedelta(1))).alias("a"),
        clock.preferred_available(F.lit(None).cast("timestamp"), F.lit(T0), F.lit(T0 - timedelta(1))).alias("b"),
        clock.local_midnight(F.lit(datetime(2026, 1, 1, 23, 30)), "Europe/Moscow").alias("m"),
    ).first()
    assert (row.a, row.b, row.m) == (T0 - timedelta(1), T0, datetime(2026, 1, 1, 21))


def test_catalog_payloads_are_parsed_once_and_after_no_filter(spark):
    """A filter on the parsed body would be pushed below the spreading of payloads and parse them again."""
    sports = [{"id": 1, "alias": "football", "name": "Football"}, {"id": 11, "parentId": 1, "name": "FC26 H2H 2x3"}]
    root = {"id": 5, "level": 1, "sportId": 11, "team1": "A", "team2": "B", "startTime": 9}
    bodies = [
        json.dumps({"sports": sports, "events": [root, {**root, "id": 6, "startTime": None}, {**root, "id": 7, "sportId": 1}]}),
        json.dumps({"sports": sports, "events": []}), json.dumps({"sports": sports}), "{not json", None,
    ]
    rows = [(number, datetime(2026, 1, 1), body) for number, body in enumerate(bodies)]
    payloads = spark.createDataFrame(rows, "payload_id long, received_at timestamp, body string").repartition("payload_id")
    found = book_catalog.parse(payloads)
    for name in ("items", "rejects", "received", "events", "quotes", "tournaments"):
        plan = found[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name
    failed = "payload requires sports and events arrays"
    items = sorted((r.payload_id, r.position, r.reject_reason) for r in found["items"].where("reject_reason IS NOT NULL").collect())
    assert items == [(0, 1, "missing startTime for event 6"), (2, -1, failed), (3, -1, failed), (4, -1, failed)]
    assert found["items"].count() == 5 and found["tournaments"].count() == 3 and found["events"].count() == 1
    assert sorted((r.payload_id, r.received) for r in found["received"].collect()) == [(0, 3), (1, 0), (2, 0), (3, 0), (4, 0)]


def _files(folder):
    return [path for path in folder.rglob("part-*") if path.is_file()]


def test_observation_files_hold_many_ids(spark, tmp_path):
    """Files of a hundred ids were as many as the input has hundreds."""
    from oddsloom.plans import ingest

    rows = [(i, T0 + timedelta(seconds=i), i % 7, "view", 20.0 + i, json.dumps({"k": i % 9})) for i in range(1200)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    table.write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("observations-*"))
    found = {row.id: row for row in ingest.observation_files(spark, str(tmp_path)).collect()}
    (landed,) = set(shared.glob("observations-*")) - before
    assert len(_files(landed)) == 1
    assert sorted(found, key=int) == [str(i) for i in range(1200)]
    assert found["1100"].odds == 1121.0 and found["1100"].v == 11.2 and found["1101"].v is None


def test_dated_appends_write_few_files(spark, tmp_path):
    """Every task had a file for each date that it held."""
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 30 * 86_400).alias("received_at"))
    upsert.append_dated(rows.repartition(8), str(tmp_path / "t"), 0)
    assert len(_files(tmp_path / "t")) == 30
    stored = upsert.read_dated(spark, str(tmp_path / "t"))
    assert stored.count() == 3000 and stored.select("received_date").distinct().count() == 30
