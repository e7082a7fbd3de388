"""Queries on stored records: match table, observations, published corridors, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import baselines, corridors, identity, matching, reports
from oddsloom.plans import bindings
from oddsloom.plans.corridor import METRICS
from oddsloom.plans.form import rounded
from oddsloom.plans.pricing import CANONICAL
from oddsloom.plans.probability import FORM_SQL, cells
from oddsloom.plans.registry import query
from oddsloom.plans.signals import NOW, SIGNALS, signals


@query("one_match_each", f"""{bindings.with_views('quotes')},
m AS (SELECT snapshot_id AS match_id, contract_event % 500 AS source_id, contract_event % 700 AS candidate_id, (snapshot_id * 37 % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN snapshot_id % 4 = 0 THEN 'rejected' ELSE 'matched' END AS status, received_at FROM quotes),
x1 AS (SELECT *, CASE WHEN status = 'matched' AND row_number() OVER (PARTITION BY source_id, status ORDER BY confidence DESC, received_at, match_id) > 1 THEN 'ambiguous' ELSE status END AS s1 FROM m),
x2 AS (SELECT *, CASE WHEN s1 = 'matched' AND row_number() OVER (PARTITION BY candidate_id, s1 ORDER BY confidence DESC, received_at, match_id) > 1 THEN 'ambiguous' ELSE s1 END AS s2 FROM x1)
SELECT match_id, s2 AS status FROM x2""")
def one_match_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one matched row per source event and per book event."""
    snapshot, contract = F.col("snapshot_id"), F.col("contract_event")
    table = bindings.quotes(spark, sf_dir).select(
        snapshot.alias("match_id"), (contract % 500).alias("source_id"), (contract % 700).alias("candidate_id"),
        ((snapshot * 37 % 101) / 100.0).alias("confidence"),
        F.when(snapshot % 4 == 0, "rejected").otherwise("matched").alias("status"),
        F.col("received_at").alias("matched_at"),
    )
    return matching.one_match_each(table).select("match_id", "status")


@query("completed_events", f"""{bindings.with_views('quotes')}
SELECT contract_event AS event_id FROM quotes GROUP BY contract_event HAVING min(kickoff) <= TIMESTAMP '{NOW}' AND min(received_at) < min(kickoff)""")
def completed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started events that had a quote before their start."""
    quotes = bindings.quotes(spark, sf_dir).withColumn("event_id", F.col("contract_event"))
    books = quotes.groupBy("event_id").agg(F.min("kickoff").alias("started_at"))
    done = matching.completed_only(books, quotes.select("event_id", "received_at"), F.lit(NOW).cast("timestamp"))
    return done.select("event_id")


@query("scheduled_events", f"""{bindings.with_views('quotes')}
SELECT contract_event AS event_id FROM quotes WHERE contract_event % 6 <> 0 GROUP BY contract_event HAVING min(kickoff) > TIMESTAMP '{NOW}'""")
def scheduled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Future events that are still scheduled."""
    events = bindings.quotes(spark, sf_dir).groupBy(F.col("contract_event").alias("event_id")).agg(
        F.min("kickoff").alias("started_at")
    )
    stated = events.withColumn("status", F.when(F.col("event_id") % 6 == 0, "live").otherwise("scheduled"))
    return matching.live_only(stated, F.lit(NOW).cast("timestamp")).select("event_id")


@query("alert_views", f"""{SIGNALS}, {bindings.CTE['matches']}
SELECT s.signal_id, CASE WHEN m.event_id % 5 <> 0 THEN 'u' || m.player1 ELSE 'P1' END AS raw_name1, CASE WHEN m.event_id % 7 <> 0 THEN 'u' || m.player2 ELSE 'P2' END AS raw_name2,
  CASE WHEN m.event_id % 5 <> 0 THEN m.game END AS raw_team_name1 FROM sig s JOIN matches m ON m.event_id = s.signal_id WHERE s.decision = 'alert'""")
def alert_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the names of both sides; a missing side has a placeholder."""
    games = bindings.matches(spark, sf_dir)
    both = F.explode(
        F.array(
            F.when(F.col("event_id") % 5 != 0, F.struct(F.lit(1).alias("side"), F.col("player1").alias("p"))),
            F.when(F.col("event_id") % 7 != 0, F.struct(F.lit(2).alias("side"), F.col("player2").alias("p"))),
        )
    )
    participants = games.select("event_id", "game", both.alias("e")).where("e IS NOT NULL").select(
        F.col("event_id").alias("signal_id"), "e.side", F.concat(F.lit("u"), F.col("e.p").cast("string")).alias("raw_name"),
        F.col("game").alias("raw_team_name"),
    )
    found = reports.with_participants(
        signals(spark, sf_dir).where("decision = 'alert'"), participants, event="signal_id"
    )
    return found.select("signal_id", "raw_name1", "raw_name2", "raw_team_name1")


@query("corridor_observations", f"""{bindings.with_views('quotes', 'matches')}, {CANONICAL},
pairs AS (SELECT contract_event, min(snapshot_id) AS source_event_id, min(kickoff) AS start FROM canon GROUP BY contract_event),
known AS (SELECT p.*, CASE WHEN contract_event % 3 = 0 THEN m.score2 ELSE m.score1 END AS a, CASE WHEN contract_event % 3 = 0 THEN m.score1 ELSE m.score2 END AS b
  FROM pairs p JOIN matches m ON m.event_id = p.source_event_id WHERE contract_event % 4 <> 0 AND p.start <= TIMESTAMP '2024-01-20'
   AND CASE WHEN m.event_id % 2 = 0 THEN m.available_at ELSE m.available_at + INTERVAL 1 DAY END <= TIMESTAMP '2024-01-20'),
closing AS (SELECT c.* FROM canon c JOIN pairs p USING (contract_event) WHERE received_at < p.start
  QUALIFY row_number() OVER (PARTITION BY contract_event, market, side, line ORDER BY received_at DESC, snapshot_id DESC) = 1)
SELECT k.contract_event AS match_id, c.market, c.side AS selection, CAST(c.line AS DOUBLE) AS line, c.snapshot_id, CASE
    WHEN side = 'P1' THEN CASE WHEN a > b THEN 'win' ELSE 'loss' END WHEN side = 'P2' THEN CASE WHEN b > a THEN 'win' ELSE 'loss' END
    WHEN side = 'X' THEN CASE WHEN a = b THEN 'win' ELSE 'loss' END WHEN a + b = line THEN 'return' WHEN (a + b > line) = (side = 'over') THEN 'win' ELSE 'loss' END AS outcome
FROM known k JOIN closing c USING (contract_event) WHERE k.start - c.received_at <= INTERVAL 12 HOUR""")
def corridor_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join of matches, results and closing quotes, settled."""
    quotes = bindings.quotes(spark, sf_dir).withColumnRenamed("contract_event", "book_event_id")
    games = bindings.matches(spark, sf_dir)
    event = F.col("book_event_id")
    pairs = quotes.groupBy("book_event_id").agg(
        F.min("snapshot_id").alias("source_event_id"), F.min("kickoff").alias("started_at")
    )
    table = pairs.select(
        event.alias("match_id"), "source_event_id", "book_event_id",
        F.when(event % 4 == 0, "ambiguous").otherwise("matched").alias("status"), (event % 3 == 0).alias("reversed_sides"),
    )
    books = pairs.select(
        event.alias("event_id"), "started_at", F.lit("football").alias("sport"), F.lit(None).cast("string").alias("game"),
        F.lit("f").alias("family"), F.lit("bookmaker").alias("source_type"), F.lit("b").alias("bookmaker"),
    )
    early = F.col("event_id") % 2 == 0
    results = games.select(
        "event_id", "score1", "score2", F.when(early, F.col("available_at")).alias("observed_at"),
        (F.col("available_at") + F.expr("INTERVAL 1 DAY")).alias("source_updated_at"), F.col("started_at").alias("settled_at"),
    )
    seen = corridors.closing_observations(
        table, games.select("event_id", F.lit("history").alias("source_type")), books, results,
        quotes.drop("kickoff", "score1", "score2"), as_of=F.lit("2024-01-20").cast("timestamp"), max_age_seconds=12 * 3600,
    )
    return seen.select(
        "match_id", "market", "selection", F.col("line").cast("double").alias("line"), "snapshot_id", "outcome"
    )


_SIDE = """(SELECT market, scope_type, scope_value, CAST(floor((odds - 1) / 0.25) AS BIGINT) AS bucket, {METRICS} FROM (
  SELECT market, 'global' AS scope_type, '' AS scope_value, odds, outcome FROM bets WHERE as_of {test}
  UNION ALL SELECT market, 'tournament_family', family, odds, outcome FROM bets WHERE family <> '' AND as_of {test})
  GROUP BY market, scope_type, scope_value, floor((odds - 1) / 0.25) HAVING count(*) >= 20)"""


@query("corridor_publish", f"""{bindings.with_views('bets')},
one AS {_SIDE.format(METRICS=METRICS, test="< TIMESTAMP '1998-01-01'")}, two AS {_SIDE.format(METRICS=METRICS, test=">= TIMESTAMP '1998-01-01'")}
SELECT market, scope_type, scope_value, bucket, sample_size, TRUE AS is_active FROM two
UNION ALL SELECT o.market, o.scope_type, o.scope_value, o.bucket, o.sample_size, FALSE FROM one o
  WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.market = o.market AND t.scope_type = o.scope_type AND t.scope_value = o.scope_value AND t.bucket = o.bucket)""")
def corridor_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rebuilds: buckets of the second replace, the others are retired."""
    bets = bindings.bets(spark, sf_dir)
    border = F.lit("1998-01-01").cast("timestamp")
    first = corridors.build(bets.where(F.col("as_of") < border), group=("market",))
    second = corridors.build(bets.where(F.col("as_of") >= border), group=("market",))
    key = ["market", "scope_type", "scope_value", "bucket"]
    none = first.withColumns(
        {"as_of": border, "is_active": F.lit(True), "retired_at": F.lit(None).cast("timestamp")}
    ).limit(0)
    published = corridors.publish(none, first, as_of=border, key=key)
    later = corridors.publish(published, second, as_of=F.lit("2002-01-01").cast("timestamp"), key=key)
    return later.select(*key, "sample_size", "is_active")


@query("participant_resolution", """WITH ents AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name)
SELECT p_partkey AS participant_id, CASE p_partkey % 5 WHEN 0 THEN 'alias' WHEN 1 THEN 'review' WHEN 2 THEN 'new' ELSE 'exact' END AS action,
  CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 3 THEN id WHEN 4 THEN id END AS known_id, p_partkey % 5 <> 1 AS attached,
  CASE p_partkey % 5 WHEN 0 THEN 'alias ' || p_partkey WHEN 1 THEN 'twin ' || p_partkey WHEN 2 THEN md5(CAST(p_partkey AS VARCHAR)) ELSE p_name END AS name,
  CASE p_partkey % 5 WHEN 2 THEN 'new' WHEN 3 THEN 'exact' WHEN 4 THEN 'exact' END AS alias_method, CASE WHEN p_partkey % 5 = 1 THEN p_partkey END AS candidate_id
FROM part JOIN ents USING (p_name)""")
def participant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the form ``Team (nickname)``: known names, an alias of the source, a name two hold elsewhere, new names.

    Ids of new entities are hashes and not compared; that each new name has one is.
    """
    part = bindings.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    entities = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    text = key.cast("string")
    nickname = (
        F.when(key % 5 == 0, F.concat(F.lit("Alias "), text)).when(key % 5 == 1, F.concat(F.lit("TWIN "), text))
        .when(key % 5 == 2, F.md5(text.cast("binary"))).otherwise(F.upper("p_name"))
    )
    people = part.select(key.alias("participant_id"), F.concat("p_brand", F.lit(" ( "), nickname, F.lit(" )")).alias("label"))
    own = part.where(key % 5 == 0).select(F.lit("s").alias("source"), F.concat(F.lit("alias "), text).alias("name"), key.alias("entity_id"))
    twins = part.where(key % 5 == 1).select(
        F.lit("x").alias("source"), F.concat(F.lit("twin "), text).alias("name"), F.explode(F.array(key, key + 1)).alias("entity_id")
    )
    out = identity.resolve_participants(
        people, entities, column="label", kind="player", source="s", aliases=own.unionByName(twins), similarity="levenshtein"
    )
    fresh = out["new_entities"].select(F.col("entity_id").alias("fresh_id"))
    aliases = out["new_aliases"].select("name", F.col("match_method").alias("alias_method"))
    reviews = out["reviews"].select("name", "candidate_id")
    rows = out["attached"].join(fresh, F.col("entity_id") == F.col("fresh_id"), "left").join(aliases, "name", "left").join(reviews, "name", "left")
    return rows.select(
        "participant_id", "action", F.when(F.col("fresh_id").isNull(), F.col("entity_id")).alias("known_id"),
        F.col("entity_id").isNotNull().alias("attached"), "name", "alias_method", "candidate_id",
    )


@query("sample_sizes", f"""{FORM_SQL}
SELECT a.event_id, a.matches AS player1_samples, b.matches AS player2_samples, h.matches AS h2h_samples
FROM pf a JOIN pf b USING (event_id) JOIN hf h USING (event_id) WHERE a.side = 1 AND b.side = 2 AND a.last_n = 0 AND b.last_n = 0 AND h.last_n = 0""")
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches each model decision rests on."""
    sized = baselines.with_sample_sizes(cells(spark, sf_dir, ()), ())
    return rounded(sized.select("event_id", "player1_samples", "player2_samples", "h2h_samples"))
