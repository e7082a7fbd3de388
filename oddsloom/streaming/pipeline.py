"""Structured Streaming jobs over snapshot, quote and result streams.

Sinks write one directory per micro-batch and replace it on a retry, so a batch
that runs twice leaves one copy. State that grows with contracts lives in the
state store; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming import StreamingQuery

from oddsloom.operators import alerts, live, quotes, upsert
from oddsloom.sources import book_catalog, ledger, raw

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk instead of the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(
    spark: SparkSession, path: str, schema, *, max_files: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def batch_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and keep its rows under ``path``.

    A batch that is tried again replaces its own directory. ``transform`` gets
    the batch's id, so that it can tell rows of earlier batches from its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def collect_snapshots(
    payloads: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None
) -> StreamingQuery:
    """Archive, parse and append catalog payloads (payload_id, received_at, provider, body) as they come.

    A micro-batch is decoded once and feeds all tables under ``path``: archive
    (content hash and size of each payload), tournaments, events, quotes,
    rejects and runs (counts, status and first reasons a payload). Each table
    has one directory a batch, which a retry replaces, and below it one a
    received date; so nothing is stored twice and a date is read alone. A
    payload that cannot be read is archived and rejected, and holds up nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        read = book_catalog.decode(batch).persist()
        found = book_catalog.tables(read)
        runs = ledger.runs(
            found["items"].select("payload_id", "position", "reject_reason"), ["payload_id"],
            received=found["received"].select("payload_id", "received"),
        ).join(read.select("payload_id", "received_at"), "payload_id")
        kept = {name: found[name] for name in ("tournaments", "events", "quotes", "rejects")}
        archived = raw.archived(batch).drop("body")
        for name, rows in {**kept, "runs": runs, "archive": archived}.items():
            upsert.append_dated(rows, f"{path}/{name}", batch_id)
        read.unpersist()

    return (
        payloads.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def distinct_payloads(payloads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First copy of each payload content seen within the delay."""
    hashed = raw.archived(payloads).withWatermark("received_at", delay)
    return hashed.dropDuplicatesWithinWatermark(["content_sha256"])


def quote_state(stream: DataFrame, keys: Sequence[str] = quotes.CONTRACT) -> DataFrame:
    """Opening and newest price per contract, kept in the state store.

    Emit in update mode: each batch brings the contracts it touched, with a
    growing number of observations.
    """
    order = F.struct("received_at", "snapshot_id")
    point = F.struct("odds", "received_at", "snapshot_id")
    return stream.groupBy(*keys).agg(
        F.min_by(point, order).alias("opening"),
        F.max_by(point, order).alias("current"),
        F.count("*").alias("observations"),
    )


def newest_state(updates: DataFrame, keys: Sequence[str] = quotes.CONTRACT) -> DataFrame:
    """Fold the update log of :func:`quote_state` to one row per contract."""
    values = F.struct("opening", "current", "observations")
    return updates.groupBy(*keys).agg(F.max_by(values, "observations").alias("s")).select(*keys, "s.*")


def sessions(
    stream: DataFrame, keys: Sequence[str], at: str = "started_at", gap: str = "45 minutes",
    delay: str = "1 day",
) -> DataFrame:
    """Sessions of consecutive starts; a gap of exactly ``gap`` stays inside."""
    window = F.session_window(at, gap)
    return (
        stream.withWatermark(at, delay)
        .groupBy(*keys, window.alias("session"))
        .agg(F.count("*").alias("matches"), F.sum("goals").alias("goals"), F.max(at).alias("last_start"))
    )


def ingest_rates(
    stream: DataFrame, at: str = "received_at", width: str = "1 hour", slide: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Snapshots and rejects per time window and source."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        stream.withWatermark(at, delay)
        .groupBy(window.alias("w"), "source")
        .agg(F.count("*").alias("received"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    )


def fresh_only(stream: DataFrame, now: Column, stale_seconds: float = 120.0) -> DataFrame:
    """Quotes young enough to act on at ``now``; strictly older ones are out."""
    age = F.unix_micros(now) - F.unix_micros("received_at")
    return stream.where(age <= int(stale_seconds * 1_000_000))


def quotes_with_results(
    quote_stream: DataFrame,
    result_stream: DataFrame,
    *,
    how: str = "leftOuter",
    quote_delay: str = "1 hour",
    result_delay: str = "1 day",
    horizon: str = "1 day",
) -> DataFrame:
    """Quotes with the result of their event, if it comes within ``horizon``.

    Both sides are watermarked and the join is bounded in time, so state is
    dropped; with an outer join a quote whose result never comes is emitted
    once the horizon has passed.
    """
    q = quote_stream.withWatermark("received_at", quote_delay)
    r = result_stream.select(
        F.col("event_id").alias("result_event_id"), "observed_at", "score1", "score2"
    ).withWatermark("observed_at", result_delay)
    condition = F.expr(
        "event_id = result_event_id AND observed_at >= received_at "
        f"AND observed_at <= received_at + INTERVAL {horizon}"
    )
    return q.join(r, condition, how).drop("result_event_id")


def stored(spark: SparkSession, path: str, like: DataFrame, before: int) -> DataFrame:
    """Rows that a sink's batches before ``before`` have written; empty before the first one.

    Directories of later batches, left by a try that failed, are pruned.
    """
    try:
        schema = StructType([*like.schema.fields, StructField("batch_id", LongType())])
        written = spark.read.schema(schema).parquet(path)
        return written.where(F.col("batch_id") < before).drop("batch_id")
    except Exception as error:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return like.limit(0)


def alert_sink(path: str, row_id: str = "prediction_id") -> Callable[[DataFrame, int], DataFrame]:
    """Transform for :func:`batch_sink`: alerts whose key was stored become skips."""

    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        known = stored(batch.sparkSession, path, batch, batch_id).where("decision = 'alert'")
        return alerts.drop_repeated(batch, known, row_id=row_id)

    return transform


def delivered_once(
    signals: DataFrame, *, key: str = "alert_key", at: str = "created_at", until: str = "expires_at", life: str = "1 day"
) -> DataFrame:
    """The alerts of a stream that are sent: one of each key, and none whose time was up when it came.

    Keys sent are state, held for ``life`` after the alert and then dropped as
    the watermark moves on; ``life`` has to cover the time from an alert to its
    ``until``, since whatever comes later is out anyway. A batch looks its own
    keys up and reads nothing that was written before.
    """
    due = signals.where((F.col("decision") == "alert") & (F.col(until).isNull() | (F.col(at) < F.col(until))))
    return due.withWatermark(at, life).dropDuplicatesWithinWatermark([key])


def with_deliveries(
    signals: DataFrame, delivered: DataFrame, *, row_id: str = "signal_id", at: str = "created_at", until: str = "expires_at"
) -> DataFrame:
    """Signals after delivery: alerts that came too late or repeat a sent key are skips with a reason."""
    sent = delivered.select(F.col(row_id), F.lit(True).alias("_sent")).distinct()
    joined = signals.join(sent, row_id, "left")
    unsent = (F.col("decision") == "alert") & F.col("_sent").isNull()
    late = F.coalesce(F.col(at) >= F.col(until), F.lit(False))
    reason = F.when(late, "delivery_expired").otherwise("duplicate_alert")
    return joined.withColumns(
        {
            "filter_reasons": F.when(unsent, F.array_append("filter_reasons", reason)).otherwise(F.col("filter_reasons")),
            "decision": F.when(unsent, "skip").otherwise(F.col("decision")),
        }
    ).select(*signals.columns)


def signal_batches(
    static: Callable[[], dict[str, DataFrame]], strategies: DataFrame, now: Callable[[], Column], path: str
) -> Callable[[DataFrame, int], DataFrame]:
    """Transform: a quote micro-batch to signals.

    ``static`` is read anew for every batch, so matches, history and corridors
    may change between batches.
    """

    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        tables = static()
        found = live.generate_signals(
            batch, tables["matches"], tables["history"], strategies, tables["corridors"], now=now()
        )
        return alert_sink(path)(found, batch_id)

    return transform


def settlement_batches(
    signals: Callable[[], DataFrame], now: Callable[[], Column], path: str
) -> Callable[[DataFrame, int], DataFrame]:
    """Transform: a micro-batch of results to settlements of open signals."""

    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        open_signals = signals()
        shape = live.settle_signals(open_signals, batch, None, now=now())
        done = stored(batch.sparkSession, path, shape, batch_id)
        return live.settle_signals(open_signals, batch, done, now=now())

    return transform
