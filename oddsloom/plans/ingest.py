"""Queries on ingestion: payloads built from the tables, parsed and stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import quotes as quote_ops
from oddsloom.operators import upsert
from oddsloom.plans import bindings
from oddsloom.plans.form import rounded
from oddsloom.plans.registry import query
from oddsloom.session import materialize, scratch_path
from oddsloom.sources import book_catalog, files, history, ledger, raw

B = bindings.CTE["b"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A payload is built from each row; rows are spread before, however few files hold them.
    events = bindings.table(spark, sf_dir, "events").repartition("event_id")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _payloads(events: DataFrame, body: Column, **extra: Column) -> DataFrame:
    return events.select(
        F.col("event_id").alias("payload_id"), F.col("ts").alias("received_at"),
        F.to_json(body).alias("body"), *[column.alias(name) for name, column in extra.items()],
    )


def _node(node_id: int, parent: int | None, name: str, alias: str | None) -> Column:
    return F.struct(
        F.lit(node_id).alias("id"), F.lit(parent).cast("int").alias("parentId"),
        F.lit(name).alias("name"), F.lit(alias).cast("string").alias("alias"),
    )


def catalog_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog per event row: a root event, its child and their factors."""
    k, event = F.col("k"), F.col("event_id")
    tree = F.array(
        _node(1, None, "Football", "football"), _node(2, None, "Hockey", "hockey"),
        _node(11, 1, "FC26. United Esports Leagues. 2x3 min. Czech", None),
        _node(12, 2, "NHL 26 H2H GG League 3х4", None), _node(99, 1, "Premier League", None),
    )
    sport = F.when(k % 3 == 0, 11).when(k % 3 == 1, 12).otherwise(99)

    def root(node_id: Column, level: int) -> Column:
        return F.struct(
            node_id.alias("id"), F.lit(level).alias("level"), sport.alias("sportId"),
            F.concat(F.lit("Team "), F.col("event_type"), F.lit(" ( u"), F.col("user_id").cast("string"), F.lit(" )")).alias("team1"),
            F.when(k % 19 != 0, F.concat(F.lit("Solo "), (k % 7).cast("string"))).alias("team2"),
            F.when(k % 17 != 0, F.floor(F.unix_micros("ts") / 1000000)).alias("startTime"),
            F.when(k % 2 == 0, "line").when(k % 5 == 0, "live").otherwise("gone").alias("place"),
        )

    def factor(number: Column | int, v: Column, p: int | None = None, pt: str | None = None) -> Column:
        chosen = F.lit(number) if isinstance(number, int) else number
        return F.struct(
            chosen.cast("bigint").alias("f"), v.cast("double").alias("v"),
            F.lit(p).cast("bigint").alias("p"), F.lit(pt).cast("string").alias("pt"),
        )

    price = F.floor((1.01 + F.col("value") / 20) * 1000) / 1000
    factors = F.array(
        factor(921, price), factor(922, F.lit(1.0)), factor(927, price + 1, -150),
        factor(930, price + 2, 999, "2.5"), factor(931, price + 3, 350), factor(928, price, None, "bad"),
        factor(1500 + k, price),
    )
    groups = F.array(
        F.struct(event.alias("e"), factors.alias("factors")),
        F.struct((event + 5000000000).alias("e"), factors.alias("factors")),
    )
    body = F.struct(
        F.lit(7).alias("packetVersion"), tree.alias("sports"),
        F.array(root(event, 1), root(event + 5000000000, 2)).alias("events"),
        groups.alias("customFactors"),
    )
    return _payloads(_events(spark, sf_dir), body)


_KEPT = "k % 3 <> 2 AND k % 19 <> 0 AND k % 17 <> 0"


@query("json_ingest", f"""WITH {B}, kept AS (SELECT *, floor((1.01::DOUBLE + value / 20) * 1000) / 1000 AS price FROM b WHERE {_KEPT}),
f AS (SELECT event_id, unnest([
  {{'factor_id': '921', 'market': '1x2', 'selection': 'P1', 'odds': price, 'line': NULL::DOUBLE}},
  {{'factor_id': '927', 'market': 'handicap', 'selection': 'F1(-1.5)', 'odds': price + 1, 'line': -1.5}},
  {{'factor_id': '930', 'market': 'total', 'selection': 'over', 'odds': price + 2, 'line': 2.5}},
  {{'factor_id': '931', 'market': 'total', 'selection': 'under', 'odds': price + 3, 'line': 3.5}},
  {{'factor_id': '928', 'market': 'unmapped_factor', 'selection': 'factor:928', 'odds': price, 'line': NULL}},
  {{'factor_id': CAST(1500 + k AS VARCHAR), 'market': 'unmapped_factor', 'selection': 'factor:' || (1500 + k), 'odds': price, 'line': NULL}}], recursive := true) FROM kept)
SELECT CAST(event_id AS VARCHAR) AS event_id, factor_id, market, selection, CAST(CAST(odds AS DECIMAL(12,5)) AS DOUBLE) AS odds, line FROM f WHERE odds > 1""")
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of root events in target tournaments."""
    quotes = book_catalog.parse(catalog_payloads(spark, sf_dir))["quotes"]
    return quotes.select(
        "event_id", "factor_id", "market", "selection", F.col("odds").cast("double").alias("odds"),
        F.col("line").cast("double").alias("line"),
    )


@query("catalog_events", f"""WITH {B}
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE k % 3 WHEN 0 THEN 'uel_ef_' ELSE 'h2h_ggl_eh_' END || event_id AS internal_id,
  CASE k % 3 WHEN 0 THEN 'football' ELSE 'hockey' END AS sport, CASE k % 3 WHEN 0 THEN 'FC26' ELSE 'NHL26' END AS game,
  CASE k % 3 WHEN 0 THEN '2x3' ELSE '3x4' END AS format, epoch_us(ts) // 1000000 AS started_s,
  CASE WHEN k % 2 = 0 THEN 'scheduled' WHEN k % 5 = 0 THEN 'live' ELSE 'unknown' END AS status,
  'Team ' || event_type AS team_name1, 'u' || user_id AS player_name1, 'Solo ' || (k % 7) AS raw_name2, CAST(NULL AS VARCHAR) AS player_name2
FROM b WHERE {_KEPT}""")
def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = book_catalog.parse(catalog_payloads(spark, sf_dir))["events"]
    return events.select(
        "event_id", "internal_id", "sport", "game", "format",
        F.floor(F.unix_micros("started_at") / 1000000).alias("started_s"), "status", "team_name1",
        "player_name1", "raw_name2", "player_name2",
    )


@query("catalog_tournaments", f"""WITH {B}
SELECT event_id AS payload_id, unnest([
  {{'tournament_id': '11', 'sport': 'football', 'game': 'FC26', 'format': '2x3', 'family': 'uel', 'country': 'CZ'}},
  {{'tournament_id': '12', 'sport': 'hockey', 'game': 'NHL26', 'format': '3x4', 'family': 'h2h_ggl', 'country': NULL}}], recursive := true) FROM b""")
def catalog_tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = book_catalog.parse(catalog_payloads(spark, sf_dir))["tournaments"]
    return parsed.select("payload_id", "tournament_id", "sport", "game", "format", "family", "country")


@query("rejection_ledger", f"""WITH {B}, items AS (SELECT dayofyear(ts) AS day, event_id,
  CASE WHEN k % 19 = 0 THEN 'invalid core fields for event ' || event_id WHEN k % 17 = 0 THEN 'missing startTime for event ' || event_id END AS reason
  FROM b WHERE k % 3 <> 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS rn FROM items WHERE reason IS NOT NULL),
shown AS (SELECT day, string_agg(reason, '; ' ORDER BY rn) AS last_error FROM ranked WHERE rn <= 20 GROUP BY day),
seen AS (SELECT dayofyear(ts) AS day, 2 * count(*) AS received FROM b GROUP BY 1)
SELECT r.day, any_value(r.received) AS received, count(i.day) FILTER (WHERE reason IS NULL) AS parsed, count(reason) AS rejected,
  CASE WHEN count(reason) > 0 THEN 'partial' ELSE 'success' END AS status, any_value(s.last_error) AS last_error
FROM seen r LEFT JOIN items i ON i.day = r.day LEFT JOIN shown s ON s.day = r.day GROUP BY r.day""")
def rejection_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parser runs per day: counts, status and the first twenty reasons."""
    # The ledger reads items twice and counts once; payloads are parsed for all of it together.
    outcomes = book_catalog.parse(catalog_payloads(spark, sf_dir))["outcomes"]
    parsed = book_catalog.outcome_tables(materialize(outcomes, "outcomes"))
    day = F.dayofyear("received_at").cast("long").alias("day")
    daily = parsed["items"].select(day, F.col("payload_id").alias("position"), "reject_reason")
    return ledger.runs(daily, ["day"], received=parsed["received"].select(day, "received"))


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    match = F.struct(
        F.concat(F.lit("FI"), F.col("event_id").cast("string")).alias("externalId"),
        F.concat(start, F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise(F.when(k % 5 == 0, "").otherwise("-0130"))).alias("startDate"),
        (k % 13 == 0).alias("isCancelled"),
        F.lit(" FRANCE ").alias("teamAName"), F.when(k % 11 != 0, "SPAIN").otherwise("  ").alias("teamBName"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("participantAName"), F.col("event_type").alias("participantBName"),
        F.lit("Stream 1").alias("streamName"), F.concat(F.lit("League  "), F.upper("event_type")).alias("tournamentName"),
        F.when(k % 4 != 0, "MATCH_ENDED").alias("matchStatus"),
        F.when(k % 4 != 0, k % 6 - 1).alias("teamAScore"), F.when(k % 4 != 0, k % 5).alias("teamBScore"),
    )
    return _payloads(_events(spark, sf_dir), F.array(match, F.lit(None).cast(match_type())))


def match_type() -> str:
    return (
        "struct<externalId:string,startDate:string,isCancelled:boolean,teamAName:string,teamBName:string,"
        "participantAName:string,participantBName:string,streamName:string,tournamentName:string,"
        "matchStatus:string,teamAScore:int,teamBScore:int>"
    )


_SCHEDULE = f"""WITH {B}, good AS (SELECT *, epoch_us(date_trunc('second', ts)) + CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN -7200000000 ELSE 5400000000 END AS started_us,
  CASE WHEN k % 4 <> 0 AND k % 6 - 1 >= 0 THEN k % 6 - 1 END AS s1, CASE WHEN k % 4 <> 0 THEN k % 5 END AS s2
  FROM b WHERE k % 11 <> 0 AND NOT (k % 3 = 2 AND k % 5 = 0)),
stated AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'cancelled' WHEN k % 4 <> 0 AND s1 IS NOT NULL THEN 'finished' WHEN k % 4 = 0 THEN 'scheduled' ELSE 'unknown' END AS status FROM good)"""


@query("schedule_ingest", f"""{_SCHEDULE}
SELECT 'FI' || event_id AS event_id, started_us, status, 'fifa:' || sha256('league ' || event_type)[1:16] AS tournament_id,
  'FRANCE' AS team_name1, s1 AS score1, s2 AS score2 FROM stated""")
def schedule_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source C: offsets, blanks, cancelled and unfinished matches."""
    events = history.parse_c_schedule(_schedule(spark, sf_dir), api_sport="fifa")["events"]
    return events.select(
        "event_id", F.unix_micros("started_at").alias("started_us"), "status", "tournament_id",
        "team_name1", "score1", "score2",
    )


@query("schedule_rejects", f"""WITH {B}
SELECT event_id AS payload_id, 1 AS position, 'match[1] is not an object' AS reject_reason FROM b
UNION ALL SELECT event_id, 0, 'match[0] has invalid core fields' FROM b WHERE k % 11 = 0 OR (k % 3 = 2 AND k % 5 = 0)""")
def schedule_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = history.parse_c_schedule(_schedule(spark, sf_dir), api_sport="fifa")["rejects"]
    return rejects.select("payload_id", "position", "reject_reason")


@query("schedule_results", f"""{_SCHEDULE}
SELECT 'FI' || event_id AS event_id, CASE WHEN s1 > s2 THEN 'P1' WHEN s2 > s1 THEN 'P2' ELSE 'X' END AS winner, s1 = s2 AS is_draw,
  s1 + s2 AS total, epoch_us(ts) AS observed_us FROM stated WHERE status = 'finished'""")
def schedule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = history.parse_c_schedule(_schedule(spark, sf_dir), api_sport="fifa")["results"]
    return results.select(
        "event_id", "winner", "is_draw", "total", F.unix_micros("observed_at").alias("observed_us")
    )


@query("tour_games_ingest", f"""WITH {B}
SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(date_trunc('second', ts)) - 10800000000 AS started_us,
  CASE k % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'unknown' ELSE 'live' END AS status,
  CASE WHEN k % 7 <> 0 THEN k % 6 END AS score1, k % 5 AS score2, CASE WHEN k % 2 = 0 THEN 'Spain' ELSE 'Испания' END AS team_name1,
  CASE WHEN k % 2 = 0 THEN 'Испания' END AS team_alternate1,
  CASE WHEN k % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) - 10800000000 + (k % 9) * 60000000 END AS updated_us FROM b WHERE k % 23 <> 0 AND (k % 3 = 0 OR k % 9 > 0)
UNION ALL SELECT CAST(event_id AS VARCHAR), epoch_us(date_trunc('second', ts)) - 10800000000,
  CASE k % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'unknown' ELSE 'live' END,
  CASE WHEN k % 7 <> 0 THEN k % 6 END, k % 5, CASE WHEN k % 2 = 0 THEN 'Spain' ELSE 'Испания' END, CASE WHEN k % 2 = 0 THEN 'Испания' END, NULL FROM b WHERE k % 23 <> 0 AND k % 3 <> 0 AND k % 9 = 0""")
def tour_games_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B: numbers as text, local wall clock, names in two languages."""
    k = F.col("k")
    wall = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    updated = F.timestamp_micros(F.unix_micros("ts") - 10800000000 + (k % 9) * 60000000)
    game = F.struct(
        F.lit("r").alias("id"), F.col("event_id").cast("string").alias("id_sl"),
        F.when(k % 23 != 0, wall).otherwise("soon").alias("date_time"),
        F.when(k % 4 == 0, "Finished").when(k % 4 == 1, "scheduled").when(k % 4 == 2, "paused").otherwise(" LIVE ").alias("state"),
        F.when(k % 3 != 0, F.date_format(updated, "yyyy-MM-dd HH:mm:ss")).alias("updated_at"),
        F.when(k % 7 != 0, (k % 6).cast("string")).otherwise("-1").alias("score_team1"), (k % 5).cast("string").alias("score_team2"),
        F.lit("1").alias("player_1_id_sl"), F.lit("2").alias("player2_id"), F.lit("One").alias("player_1_title_en"),
        F.lit("Два").alias("player_2_title_ru"), F.lit("10").alias("team_1_id_sl"), F.lit("20").alias("team_2_id_sl"),
        F.when(k % 2 == 0, "Spain").otherwise(" ").alias("team_1_title_en"), F.lit("Испания").alias("team_1_title_ru"),
        F.lit("Italy").alias("team_2_title_en"),
    )
    body = F.struct(F.struct(F.array(game).alias("games")).alias("tour_blocks"))
    parsed = history.parse_b_games(_payloads(_events(spark, sf_dir), body), zone="Europe/Moscow", sport="efootball")
    return parsed["events"].select(
        "event_id", F.unix_micros("started_at").alias("started_us"), "status", "score1", "score2",
        "team_name1", "team_alternate1", F.unix_micros("source_updated_at").alias("updated_us"),
    )


@query("tournament_matches_ingest", f"""WITH {B}
SELECT CAST(event_id AS VARCHAR) AS event_id, 'Liga ' || event_type AS tournament_name, epoch_us(date_trunc('second', ts)) AS started_us,
  CASE WHEN k % 4 = 3 AND k % 5 <> 0 THEN 'finished' ELSE 'unknown' END AS status, 'nick' || user_id AS player_key1,
  CASE WHEN k % 2 = 0 THEN 'Spain' ELSE 'Испания' END AS team_name1, CASE WHEN k % 5 <> 0 THEN k % 6 END AS score1 FROM b WHERE k % 7 <> 0""")
def tournament_matches_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A: a tournament with its matches, nested participants and teams."""
    k = F.col("k")

    def participant(nick: Column, score: Column) -> Column:
        return F.struct(
            F.lit(5).alias("id"), nick.alias("nickname"), score.alias("score"),
            F.struct(F.lit(9).alias("id"), F.lit("Испания").alias("token"),
                     F.when(k % 2 == 0, "Spain").alias("token_international")).alias("team"),
        )

    match = F.struct(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        (k % 4).alias("status_id"),
        participant(F.concat(F.lit(" nick"), F.col("user_id").cast("string")), F.when(k % 5 != 0, k % 6)).alias("participant1"),
        participant(F.when(k % 7 != 0, "other").otherwise(" "), k % 5).alias("participant2"),
    )
    head = F.struct(F.lit(3).alias("id"), F.lit(4).alias("status_id"), F.concat(F.lit("Liga "), "event_type").alias("token"))
    payloads = _payloads(_events(spark, sf_dir), F.array(match), tournament=F.to_json(head))
    return history.parse_a_matches(payloads)["events"].select(
        "event_id", "tournament_name", F.unix_micros("started_at").alias("started_us"), "status",
        "player_key1", "team_name1", "score1",
    )


@query("tour_pages_ingest", f"""WITH {B}
SELECT event_id AS payload_id, 'Stream ' || k AS name, 'finished' AS state, CAST(ceil((1000 + k) / 20.0) AS BIGINT) AS total_pages FROM b""")
def tour_pages_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B pages: the first finished tour of each page and the page count."""
    k = F.col("k")

    def tour(state: str, name: Column) -> Column:
        return F.struct(
            F.lit("1").alias("id"), F.lit("2").alias("id_sl"), F.lit(" ").alias("title_en"),
            name.alias("title_ru"), F.lit("CZ").alias("country"), F.lit(state).alias("state"),
        )

    shown = F.concat(F.lit("Stream "), k.cast("string"))
    body = F.struct(
        F.array(tour("upcoming", F.lit("x")), tour("Finished", shown), tour("finished", F.lit("later"))).alias("items"),
        (1000 + k).cast("string").alias("total_items"),
    )
    parsed = history.parse_b_page(_payloads(_events(spark, sf_dir), body), items_per_page=20)
    first = history.first_finished(parsed["rows"], 1)
    return first.join(parsed["pages"], "payload_id").select("payload_id", "name", "state", "total_pages")


@query("tournament_pages_ingest", f"""WITH {B}
SELECT event_id AS payload_id, CAST(event_id AS VARCHAR) AS tournament_id, event_type AS name, CAST(k % 5 AS BIGINT) AS status_id, CAST(3 AS BIGINT) AS total_pages FROM b WHERE k % 6 <> 0""")
def tournament_pages_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A pages: references with a name in either language."""
    k = F.col("k")
    reference = F.struct(
        F.col("event_id").alias("id"), F.when(k % 6 != 0, k % 5).alias("status_id"),
        F.when(k % 2 == 0, F.col("event_type")).alias("token"),
        F.when(k % 2 == 1, F.concat(F.lit("  "), "event_type")).alias("token_international"),
    )
    body = F.struct(F.lit(3).alias("totalPages"), F.array(reference).alias("tournaments"))
    parsed = history.parse_a_page(_payloads(_events(spark, sf_dir), body))
    return parsed["rows"].join(parsed["pages"], "payload_id").select(
        "payload_id", "tournament_id", "name", "status_id", "total_pages"
    )


@query("payload_dedup", """SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first_doc, any_value(octet_length(encode(text))) AS size_bytes FROM documents GROUP BY sha256(text)""")
def payload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents of whole documents with their number of copies."""
    documents = bindings.table(spark, sf_dir, "documents")
    payloads = documents.select(
        F.lit("docs").alias("provider"), "doc_id",
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("received_at"),
        F.encode("text", "UTF-8").alias("body"),
    )
    copies = raw.first_copies(payloads)
    return copies.select(
        "content_sha256", "copies", F.col("doc_id").alias("first_doc"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
    )


@query("header_redaction", """SELECT page_id, url AS kept, 2 AS headers FROM pages""")
def header_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bindings.table(spark, sf_dir, "pages")
    headers = F.create_map(
        F.lit("Location"), "url", F.lit("Set-Cookie"), F.lit("a"), F.lit("AUTHORIZATION"), F.lit("b"),
        F.lit("Content-Type"), F.lit("text/html"),
    )
    safe = pages.select("page_id", raw.redacted(headers).alias("h"))
    return safe.select("page_id", F.col("h")["Location"].alias("kept"), F.size("h").alias("headers"))


@query("upsert_latest", """SELECT user_id, event_type, max(event_id) FILTER (WHERE rn = 1) AS event_id, round(max(value) FILTER (WHERE rn = 1), 6) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id, event_type""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last payload wins per natural key, stored and new rows together."""
    events = bindings.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    middle = F.lit("2024-01-16").cast("timestamp")
    stored = upsert.upsert_latest(
        None, events.where(F.col("ts") < middle), keys=["user_id", "event_type"], order=["ts", "event_id"]
    )
    merged = upsert.upsert_latest(
        stored, events.where(F.col("ts") >= middle), keys=["user_id", "event_type"], order=["ts", "event_id"]
    )
    return rounded(merged.select("user_id", "event_type", "event_id", "value"))


@query("upsert_results", f"""WITH {B}
SELECT user_id AS event_id, arg_max(k % 6, ts) AS score1, arg_max(k // 6 % 5, ts) AS score2, epoch_us(min(ts)) AS observed_us FROM b GROUP BY user_id""")
def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest score of an event with the earliest time anyone saw it."""
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("event_id"), F.col("event_id").alias("payload_id"),
        F.col("ts").alias("received_at"), F.col("ts").alias("observed_at"),
        (F.col("k") % 6).alias("score1"), (F.floor(F.col("k") / 6) % 5).cast("int").alias("score2"),
    )
    merged = upsert.upsert_results(None, rows)
    return merged.select("event_id", "score1", "score2", F.unix_micros("observed_at").alias("observed_us"))


@query("append_new", """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'""")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a full reload that the store does not hold yet."""
    events = bindings.table(spark, sf_dir, "events").select("event_id", "ts")
    stored = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return upsert.append_new(stored, events, keys=["event_id"]).select("event_id")


@query("append_odds", f"""{bindings.with_views('quotes')}
SELECT CAST(CAST(received_at AS DATE) AS VARCHAR) AS received_date, snapshot_id % 2 AS batch_id, count(*) AS quotes, CAST(sum(odds) AS DOUBLE) AS odds FROM quotes GROUP BY ALL""")
def append_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds appended in two batches by received date, the first of them twice."""
    quotes = bindings.quotes(spark, sf_dir).select("snapshot_id", "received_at", "odds")
    path = scratch_path(spark, "odds")
    for batch in (0, 1, 0):
        upsert.append_dated(quotes.where(F.col("snapshot_id") % 2 == batch), path, batch)
    return upsert.read_dated(spark, path).groupBy(F.col("received_date").cast("string").alias("received_date"), F.col("batch_id").cast("long").alias("batch_id")).agg(
        F.count("*").alias("quotes"), F.sum("odds").cast("double").alias("odds")
    )


@query("observation_files", f"""WITH {B}
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS market, round(value + 1, 4) AS odds, CASE WHEN k % 3 = 0 THEN NULL ELSE round(value / 100, 4) END AS v,
  '{{"odds":' || 1 + k || ',"text":"a \\"quoted\\", one"}}' AS detail FROM b""")
def observation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of JSON arrays read as observations, written as JSON and CSV reports, and both read back."""
    events = _events(spark, sf_dir)
    item = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("market"),
        F.round(F.col("value") + 1, 4).alias("odds"), F.when(F.col("k") % 3 != 0, F.round(F.col("value") / 100, 4)).alias("v"),
    )
    # One file a ten thousand ids, about a megabyte, each one array; files of a few rows cost more than their content.
    arrays = events.groupBy(F.floor(F.col("event_id") / 10_000).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    landed, out = scratch_path(spark, "observations"), scratch_path(spark, "reports")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(landed)
    read = files.read_observations(spark, landed)
    report = read.join(events.select(F.col("event_id").cast("string").alias("id"), "k"), "id").select(
        "id", "market", "odds", "v", F.struct((F.lit(1) + F.col("k")).alias("odds"), F.lit('a "quoted", one').alias("text")).alias("detail")
    )
    files.write_json(report.select("id", "market", "odds"), f"{out}/json")
    files.write_csv(report.select("id", "v", "detail"), f"{out}/csv")
    left = spark.read.schema("id string, market string, odds double").json(f"{out}/json")
    right = spark.read.option("header", "true").option("escape", "\\").schema("id string, v double, detail string").csv(f"{out}/csv")
    return left.join(right, "id").select("id", "market", "odds", "v", "detail")


_QUOTED = """q AS (SELECT event_id, ts, dayofyear(ts) AS day, user_id * 1000 + dayofyear(ts) AS contract_event, event_type AS selection, CAST(value / 20 AS DECIMAL(12,5)) AS odds,
    CASE WHEN CAST(value / 20 AS DECIMAL(12,5)) <= 1 THEN 'odds of one or less' WHEN ts >= date_trunc('day', ts) + INTERVAL 18 HOUR THEN 'quoted after kickoff' END AS reason FROM events)"""


def _checked_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they come, low odds and late ones among them, each with the reason to refuse it."""
    events = bindings.table(spark, sf_dir, "events")
    quotes = events.select(
        "event_id", F.col("ts").alias("received_at"), F.dayofyear("ts").cast("long").alias("day"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("contract_event"), F.col("event_type").alias("selection"),
        (F.col("value") / 20).cast("decimal(12,5)").alias("odds"),
        (F.date_trunc("day", "ts") + F.expr("INTERVAL 18 HOURS")).alias("kickoff"),
    )
    low, late = F.col("odds") <= 1, F.col("received_at") >= F.col("kickoff")
    return quotes.withColumn("reject_reason", F.when(low, "odds of one or less").when(late, "quoted after kickoff"))


@query("quote_ledger", f"""WITH {_QUOTED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS rn FROM q WHERE reason IS NOT NULL),
shown AS (SELECT day, string_agg(reason, '; ' ORDER BY rn) AS last_error FROM ranked WHERE rn <= 20 GROUP BY day)
SELECT q.day, count(*) AS received, count(*) FILTER (WHERE reason IS NULL) AS parsed, count(reason) AS rejected,
  CASE WHEN count(reason) > 0 THEN 'partial' ELSE 'success' END AS status, any_value(s.last_error) AS last_error
FROM q LEFT JOIN shown s ON s.day = q.day GROUP BY q.day""")
def quote_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and first reasons a day of quotes that are refused for low odds or for coming after kickoff."""
    checked = _checked_quotes(spark, sf_dir)
    return ledger.runs(checked.withColumn("position", F.col("event_id")), ["day"])


@query("accepted_quotes", f"""WITH {_QUOTED}, kept AS (SELECT * FROM q WHERE reason IS NULL)
SELECT contract_event, selection, CAST(arg_min(odds, (ts, event_id)) AS DOUBLE) AS opening_odds, CAST(arg_max(odds, (ts, event_id)) AS DOUBLE) AS current_odds, count(*) AS observations
FROM kept GROUP BY contract_event, selection""")
def accepted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price movement over what the ledger lets through."""
    accepted, _ = ledger.split(_checked_quotes(spark, sf_dir))
    keys = ("contract_event", "selection")
    moved = quote_ops.odds_movement(accepted.withColumnRenamed("event_id", "snapshot_id"), keys)
    return moved.select(*keys, "opening_odds", "current_odds", "observations")
