"""Queries that run a stream over a whole table to its end and return the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import alerts
from oddsloom.plans import bindings, ingest
from oddsloom.plans.form import rounded
from oddsloom.plans.registry import query
from oddsloom.session import scratch_path, use_utc
from oddsloom.streaming import pipeline


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    pipeline.use_rocksdb(spark)
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = pipeline.file_stream(spark, f"{sf_dir}/events*.parquet", schema)
    return stream.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "k": F.get_json_object("props", "$.k").cast("int"),
        }
    )


def run(
    stream: DataFrame, name: str, *, mode: str = "append",
    transform: Callable[[str], Callable[[DataFrame, int], DataFrame]] | None = None,
) -> DataFrame:
    """Process everything available and read back what the sink holds."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    step = transform(out) if transform else None
    pipeline.batch_sink(stream, out, checkpoint, mode=mode, transform=step).awaitTermination()
    return spark.read.parquet(out)


@query("session_windows_stream", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts)) AS last_start_us, count(*) AS matches, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT) % 6) AS BIGINT) AS goals FROM s GROUP BY user_id, island""")
def session_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions at the end of the stream; a live job emits closed ones instead."""
    stream = events_stream(spark, sf_dir).select(
        "user_id", F.col("ts").alias("started_at"), (F.col("k") % 6).alias("goals")
    )
    state = run(pipeline.sessions(stream, ["user_id"]), "sessions", mode="complete")
    newest = state.where(F.col("batch_id") == state.agg(F.max("batch_id")).scalar())
    return newest.select(
        "user_id", F.unix_micros("session.start").alias("session_start_us"),
        F.unix_micros("last_start").alias("last_start_us"), "matches", "goals",
    )


@query("latest_quote_stream", """WITH q AS (SELECT user_id * 1000 + dayofyear(ts) AS contract_event, event_type AS selection, ts, event_id, CAST(1.001::DOUBLE + value / 20 AS DECIMAL(12,5)) AS odds FROM events)
SELECT contract_event, selection, CAST(arg_min(odds, ts) AS DOUBLE) AS opening_odds, CAST(arg_max(odds, ts) AS DOUBLE) AS current_odds, arg_max(event_id, ts) AS snapshot_id, count(*) AS observations FROM q GROUP BY contract_event, selection""")
def latest_quote_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and newest price per contract from streaming state."""
    stream = events_stream(spark, sf_dir).select(
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("contract_event"),
        F.col("event_type").alias("selection"), F.col("ts").alias("received_at"),
        F.col("event_id").alias("snapshot_id"), (F.lit(1.001) + F.col("value") / 20).cast("decimal(12,5)").alias("odds"),
    )
    keys = ("contract_event", "selection")
    updates = run(pipeline.quote_state(stream, keys), "quotes", mode="update")
    state = pipeline.newest_state(updates, keys)
    return state.select(
        *keys, F.col("opening.odds").cast("double").alias("opening_odds"),
        F.col("current.odds").cast("double").alias("current_odds"),
        F.col("current.snapshot_id").alias("snapshot_id"), "observations",
    )


@query("payload_dedup_stream", """SELECT count(*) AS contents, CAST(sum(copies) AS BIGINT) AS payloads FROM (SELECT count(*) AS copies FROM documents GROUP BY sha256(text))""")
def payload_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads arriving within a day; each content passes once."""
    use_utc(spark)
    pipeline.use_rocksdb(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = pipeline.file_stream(spark, f"{sf_dir}/documents*.parquet", schema)
    seconds = F.lit(1700000000) + F.col("doc_id") % 86400
    payloads = stream.select(
        F.lit("docs").alias("provider"), F.timestamp_seconds(seconds).alias("received_at"),
        F.encode("text", "UTF-8").alias("body"),
    )
    kept = run(pipeline.distinct_payloads(payloads, "2 days").drop("body"), "payloads")
    total = bindings.table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return kept.agg(F.count("*").alias("contents")).select(
        "contents", total.alias("payloads")
    )


@query("ingest_rates_stream", """WITH b AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type AS source, count(*) AS received, count(*) FILTER (WHERE k % 17 = 0) AS rejected FROM b GROUP BY ALL""")
def ingest_rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots and rejects per hour and source."""
    stream = events_stream(spark, sf_dir).select(
        F.col("ts").alias("received_at"), F.col("event_type").alias("source"),
        F.when(F.col("k") % 17 == 0, "bad").alias("reject_reason"),
    )
    state = run(pipeline.ingest_rates(stream), "rates", mode="complete")
    newest = state.where(F.col("batch_id") == state.agg(F.max("batch_id")).scalar())
    return newest.select(F.unix_micros("w.start").alias("window_us"), "source", "received", "rejected")


@query("results_join_stream", """WITH q AS (SELECT event_id, ts AS received_at, value FROM events),
r AS (SELECT event_id, ts + to_minutes(CAST(json_extract_string(props, '$.k') AS INT) * 30) AS observed_at, CAST(json_extract_string(props, '$.k') AS INT) % 6 AS score1 FROM events)
SELECT event_id, round(value, 6) AS value, score1 FROM q JOIN r USING (event_id) WHERE observed_at >= received_at AND observed_at <= received_at + INTERVAL 1 DAY""")
def results_join_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream interval join of quotes with results that come within a day."""
    quotes = events_stream(spark, sf_dir).select("event_id", F.col("ts").alias("received_at"), "value")
    results = events_stream(spark, sf_dir).select(
        "event_id", F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("long") * 1800000000).alias("observed_at"),
        (F.col("k") % 6).alias("score1"), (F.col("k") % 5).alias("score2"),
    )
    joined = run(pipeline.quotes_with_results(quotes, results, how="inner"), "results")
    return rounded(joined.select("event_id", "value", "score1"))


@query("alert_dedup_stream", """SELECT user_id * 1000 + dayofyear(ts) AS event_key, min(event_id) AS signal_id FROM events GROUP BY 1""")
def alert_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream, each key delivered once across batches."""
    stream = events_stream(spark, sf_dir).select(
        F.col("event_id").alias("signal_id"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("event_key"),
        F.lit("alert").alias("decision"), F.array().cast("array<string>").alias("filter_reasons"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).cast("string").alias("alert_key"),
    )
    out = run(stream, "alerts", transform=lambda path: pipeline.alert_sink(path, "signal_id"))
    return out.where("decision = 'alert'").select("event_key", "signal_id")


@query("stale_quotes_stream", """SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 86400000000""")
def stale_quotes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events_stream(spark, sf_dir).select("event_id", F.col("ts").alias("received_at"))
    fresh = pipeline.fresh_only(stream, F.lit("2024-01-20").cast("timestamp"), 86400.0)
    return run(fresh, "fresh").select("event_id")


_BROKEN = "event_id % 11 = 3 OR event_id % 13 = 5"


@query("snapshot_stream", f"""WITH b AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, floor((1.01::DOUBLE + value / 20) * 1000) / 1000 AS price FROM events),
c AS (SELECT *, CASE WHEN {_BROKEN} THEN 'payload requires sports and events arrays' WHEN k % 3 <> 2 AND k % 19 = 0 THEN 'invalid core fields for event ' || event_id
    WHEN k % 3 <> 2 AND k % 17 = 0 THEN 'missing startTime for event ' || event_id END AS reason FROM b)
SELECT event_id AS payload_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS received_date, CAST(CASE WHEN {_BROKEN} THEN 0 ELSE 2 END AS BIGINT) AS received,
  CAST(CASE WHEN reason IS NULL AND k % 3 <> 2 THEN 1 ELSE 0 END AS BIGINT) AS parsed, CAST(CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rejected,
  CASE WHEN reason IS NULL THEN 'success' ELSE 'partial' END AS status, reason AS last_error,
  CAST(CASE WHEN reason IS NULL AND k % 3 <> 2 THEN 3 + 3 * (price > 1)::INT ELSE 0 END AS BIGINT) AS quotes,
  CASE WHEN reason IS NULL AND k % 3 <> 2 THEN CAST(CAST(price + 3 AS DECIMAL(12,5)) AS DOUBLE) END AS highest, CAST(1 AS BIGINT) AS copies FROM c""")
def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog payloads landing in several files, some of them unreadable, collected over several micro-batches."""
    payloads = ingest.catalog_payloads(spark, sf_dir)
    pipeline.use_rocksdb(spark)
    broken = F.when(F.col("payload_id") % 11 == 3, F.lit("{not json")).when(F.col("payload_id") % 13 == 5, F.lit('{"sports": []}'))
    landed = scratch_path(spark, "landed")
    payloads.withColumn("body", F.coalesce(broken, "body")).withColumn("provider", F.lit("book")).repartition(6, "payload_id").write.json(landed)
    schema = "payload_id long, received_at timestamp, body string, provider string"
    stream = pipeline.file_stream(spark, landed, schema, max_files=2, fmt="json")
    out = scratch_path(spark, "snapshots")
    pipeline.collect_snapshots(stream, out, scratch_path(spark, "snapshots-progress")).awaitTermination()
    runs = spark.read.parquet(f"{out}/runs")
    quotes = spark.read.parquet(f"{out}/quotes").groupBy("payload_id").agg(
        F.count("*").alias("quotes"), F.max("odds").cast("double").alias("highest")
    )
    archive = spark.read.parquet(f"{out}/archive").groupBy("payload_id").agg(F.count("*").alias("copies"))
    return runs.join(quotes, "payload_id", "left").join(archive, "payload_id", "left").select(
        "payload_id", F.col("received_date").cast("string").alias("received_date"), "received", "parsed", "rejected", "status", "last_error",
        F.coalesce("quotes", F.lit(0).cast("long")).alias("quotes"), "highest", "copies",
    )


@query("alert_delivery_stream", """WITH a AS (SELECT event_id, ts, user_id * 1000 + dayofyear(ts) AS event_key, CAST(json_extract_string(props, '$.k') AS INT) % 5 <> 0 AS alert,
    ts >= date_trunc('day', ts) + INTERVAL 18 HOUR AS late FROM events)
SELECT event_key, count(*) AS signals, CAST(max(CASE WHEN alert AND NOT late THEN 1 ELSE 0 END) AS BIGINT) AS sent, count(*) FILTER (WHERE alert AND late) AS expired,
  greatest(count(*) FILTER (WHERE alert AND NOT late) - 1, 0) AS repeated, count(*) FILTER (WHERE NOT alert) AS skipped FROM a GROUP BY event_key""")
def alert_delivery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a stream in five batches by time; each key is sent once before its kickoff, and its state then goes."""
    events = bindings.table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    signals = events.select(
        F.col("event_id").alias("signal_id"), F.col("ts").alias("created_at"), (day + F.expr("INTERVAL 18 HOURS")).alias("expires_at"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("event_key"),
        F.when(F.get_json_object("props", "$.k").cast("int") % 5 != 0, "alert").otherwise("skip").alias("decision"),
        F.array().cast("array<string>").alias("filter_reasons"),
    ).withColumn("alert_key", F.col("event_key").cast("string"))
    pipeline.use_rocksdb(spark)
    landed = scratch_path(spark, "signals")
    six_days = F.floor(F.unix_micros("created_at") / F.lit(6 * 86_400_000_000))
    dated = signals.withColumn("slot", six_days - signals.agg(F.min(six_days)).scalar())
    for number in range(5):
        chosen = F.col("slot") == number if number < 4 else F.col("slot") >= number
        dated.where(chosen).drop("slot").coalesce(1).write.mode("append").parquet(landed)
    stream = pipeline.file_stream(spark, landed, signals.schema, max_files=1)
    sent = run(pipeline.delivered_once(stream), "delivered")
    after = pipeline.with_deliveries(spark.read.parquet(landed), sent)
    reason = F.try_element_at("filter_reasons", F.lit(-1))
    return after.groupBy("event_key").agg(
        F.count("*").alias("signals"), F.count_if(F.col("decision") == "alert").alias("sent"),
        F.count_if(reason == "delivery_expired").alias("expired"),
        F.count_if(reason == "duplicate_alert").alias("repeated"),
        F.count_if((F.size("filter_reasons") == 0) & (F.col("decision") == "skip")).alias("skipped"),
    )
