"""The engine's inputs, derived from the benchmark tables.

``matches``, ``book``, ``quotes`` and ``bets`` are projections of whole tables,
given once as DataFrames and once as SQL text (``CTE``) for the side-by-side
check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table with naive timestamps read as UTC instants."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {
        field.name: F.col(field.name).cast("timestamp")
        for field in df.schema
        if field.dataType.typeName() == "timestamp_ntz"
    }
    return df.withColumns(casts) if casts else df


def _minutes(count: Column) -> Column:
    return F.make_interval(mins=count)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    users = events.agg((F.max("user_id") + 1).alias("n")).scalar()
    return events.withColumns(
        {"k": F.get_json_object("props", "$.k").cast("int"), "n": users}
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished matches with the clock at which the result was known."""
    k, n, user = F.col("k"), F.col("n"), F.col("user_id")
    return _base(spark, sf_dir).select(
        "event_id",
        F.col("ts").alias("started_at"),
        (F.col("ts") + _minutes(F.lit(5) + k % 30)).alias("available_at"),
        F.when(k % 10 == 0, "hockey").otherwise("football").alias("sport"),
        F.when(k % 2 == 0, "hist_a").otherwise("hist_b").alias("source"),
        F.col("event_type").alias("game"),
        F.when(k % 4 == 0, None)
        .otherwise(F.concat(F.lit("t"), (k % 4).cast("string")))
        .alias("tournament_key"),
        user.alias("player1"),
        ((user + 1 + k % (n - 1)) % n).alias("player2"),
        (k % 6).cast("int").alias("score1"),
        (F.floor(k / 6) % 5).cast("int").alias("score2"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other source's schedule: shifted starts, sides swapped now and then."""
    event = F.col("event_id")
    swapped = event % 3 == 0
    return matches(spark, sf_dir).select(
        (event + 1000000000).alias("event_id"),
        (F.col("started_at") + _minutes((event % 25).cast("int"))).alias("started_at"),
        "sport",
        F.when(swapped, F.col("player2")).otherwise(F.col("player1")).alias("player1"),
        F.when(swapped, F.col("player1")).otherwise(F.col("player2")).alias("player2"),
        "tournament_key",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds snapshots with kickoff and final score, partly in older notation."""
    day = F.dayofyear("ts")
    user, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    line = F.lit(0.5) + F.lit(0.5) * (k % 8)
    return _base(spark, sf_dir).select(
        F.col("event_id").alias("snapshot_id"),
        (user * 1000 + day).alias("contract_event"),
        (F.date_trunc("day", "ts") + F.expr("INTERVAL 18 HOURS")).alias("kickoff"),
        F.col("ts").alias("received_at"),
        F.when(kind.isin("view", "click", "purchase"), "1x2").otherwise("total").alias("market"),
        F.when(kind == "view", "P1")
        .when(kind == "click", "X")
        .when(kind == "purchase", "P2")
        .when(kind == "signup", "over")
        .otherwise(F.concat(F.lit("TM("), line.cast("decimal(10,1)").cast("string"), F.lit(")")))
        .alias("selection"),
        F.when(kind.isin("signup", "error"), line.cast("decimal(10,3)")).alias("line"),
        (F.lit(1.001) + F.col("value") / 20).cast("decimal(12,5)").alias("odds"),
        ((user * 7 + day) % 5).cast("int").alias("score1"),
        ((user * 3 + day) % 4).cast("int").alias("score2"),
    )


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled bets at volume, one row per line item."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag, priority = F.col("l_returnflag"), F.col("o_orderpriority")
    return joined.select(
        (F.lit(1.01) + F.col("l_discount") * 10 + F.col("l_tax") * 5)
        .cast("decimal(12,5)")
        .alias("odds"),
        F.when(flag == "A", "win").when(flag == "R", "loss").otherwise("return").alias("outcome"),
        F.col("l_linestatus").alias("market"),
        F.when(priority.startswith("3"), "").otherwise(priority).alias("family"),
        F.col("o_orderdate").alias("as_of"),
    )


def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match as a target whose cutoff is its own start."""
    return matches(spark, sf_dir).withColumn("cutoff_at", F.col("started_at"))


CTE = {
    "b": """b AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  (SELECT max(user_id) + 1 FROM events) AS n FROM events e)""",
    "matches": """matches AS (
SELECT event_id, ts AS started_at, ts + to_minutes(5 + k % 30) AS available_at,
       CASE WHEN k % 10 = 0 THEN 'hockey' ELSE 'football' END AS sport,
       CASE WHEN k % 2 = 0 THEN 'hist_a' ELSE 'hist_b' END AS source,
       event_type AS game, CASE WHEN k % 4 = 0 THEN NULL ELSE 't' || (k % 4) END AS tournament_key,
       user_id AS player1, (user_id + 1 + k % (n - 1)) % n AS player2,
       k % 6 AS score1, (k // 6) % 5 AS score2
FROM b)""",
    "book": """book AS (
SELECT event_id + 1000000000 AS event_id, started_at + to_minutes(event_id % 25) AS started_at, sport,
       CASE WHEN event_id % 3 = 0 THEN player2 ELSE player1 END AS player1,
       CASE WHEN event_id % 3 = 0 THEN player1 ELSE player2 END AS player2, tournament_key
FROM matches)""",
    "quotes": """quotes AS (
SELECT event_id AS snapshot_id, user_id * 1000 + dayofyear(ts) AS contract_event,
       CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 18 HOUR AS kickoff, ts AS received_at,
       CASE WHEN event_type IN ('view','click','purchase') THEN '1x2' ELSE 'total' END AS market,
       CASE event_type WHEN 'view' THEN 'P1' WHEN 'click' THEN 'X' WHEN 'purchase' THEN 'P2'
            WHEN 'signup' THEN 'over' ELSE 'TM(' || CAST(0.5 + 0.5 * (k % 8) AS DECIMAL(10,1)) || ')' END AS selection,
       CASE WHEN event_type IN ('signup','error') THEN CAST(0.5 + 0.5 * (k % 8) AS DECIMAL(10,3)) END AS line,
       CAST(1.001::DOUBLE + value / 20 AS DECIMAL(12,5)) AS odds,
       (user_id * 7 + dayofyear(ts)) % 5 AS score1, (user_id * 3 + dayofyear(ts)) % 4 AS score2
FROM b)""",
    "bets": """bets AS (
SELECT CAST(1.01 + l_discount * 10 + l_tax * 5 AS DECIMAL(12,5)) AS odds,
       CASE l_returnflag WHEN 'A' THEN 'win' WHEN 'R' THEN 'loss' ELSE 'return' END AS outcome,
       l_linestatus AS market, CASE WHEN o_orderpriority LIKE '3%' THEN '' ELSE o_orderpriority END AS family,
       o_orderdate AS as_of
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}
_NEEDS = {"matches": ("b", "matches"), "book": ("b", "matches", "book"), "quotes": ("b", "quotes"), "bets": ("bets",)}


def with_views(*views: str) -> str:
    """``WITH`` clause defining the views and what they build on; ends open."""
    names: list[str] = []
    for view in views:
        names += [name for name in _NEEDS[view] if name not in names]
    return "WITH " + ",\n".join(CTE[name] for name in names)
