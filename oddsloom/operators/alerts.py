"""Choosing, deduplicating and expiring alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.functions import odds as odds_fn


def _append(reasons: Column, condition: Column, label: str) -> Column:
    return F.when(condition, F.array_append(reasons, F.lit(label))).otherwise(reasons)


def skip_if(df: DataFrame, condition: Column, label: str, *, only_alerts: bool = True) -> DataFrame:
    """Turn alerts that meet the condition into skips with one more reason."""
    hit = F.coalesce(condition, F.lit(False))
    if only_alerts:
        hit = hit & (F.col("decision") == "alert")
    return df.withColumns(
        {
            "filter_reasons": _append(F.col("filter_reasons"), hit, label),
            "decision": F.when(hit, "skip").otherwise(F.col("decision")),
        }
    )


def best_per_event(
    candidates: DataFrame,
    *,
    run: Sequence[str] = ("strategy",),
    event: str = "event_id",
    row_id: str = "prediction_id",
    limit: Column | int = 1,
) -> DataFrame:
    """Ids of the alerts that win their event.

    First the best alert of each event and market by value, probability and
    lowest id; then the best markets of the event. The first step is an
    aggregate, so an event with very many candidates reduces before the
    shuffle, and the window sees one row per market.
    """
    alerts = candidates.where(F.col("decision") == "alert")
    cap = F.lit(limit) if isinstance(limit, int) else limit
    rank = F.struct("value_percent", "probability", -F.col(row_id))
    best = alerts.groupBy(*run, event, "market").agg(
        F.max_by(F.struct(row_id, "value_percent", "probability", cap.alias("cap")), rank).alias("b")
    ).select(*run, event, "market", "b.*")
    order = Window.partitionBy(*run, event).orderBy(
        F.desc("value_percent"), F.desc("probability"), row_id
    )
    return best.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= F.col("cap")
    ).select(*run, row_id)


def select_alerts(
    candidates: DataFrame,
    *,
    run: Sequence[str] = ("strategy",),
    event: str = "event_id",
    row_id: str = "prediction_id",
    limit: Column | int = 1,
) -> DataFrame:
    """Candidates with losers of :func:`best_per_event` turned into skips."""
    winners = best_per_event(candidates, run=run, event=event, row_id=row_id, limit=limit)
    marked = candidates.join(winners.withColumn("_won", F.lit(True)), [*run, row_id], "left")
    return skip_if(marked, F.col("_won").isNull(), "better_selection_available").drop("_won").select(
        *candidates.columns
    )


def drop_repeated(
    alerts: DataFrame, stored_keys: DataFrame, *, row_id: str = "prediction_id"
) -> DataFrame:
    """Skip alerts whose key is stored already or claimed by a lower id.

    Rerunning a batch finds its own keys stored, so nothing is sent twice.
    """
    keyed = alerts.where(F.col("decision") == "alert")
    first = keyed.groupBy("alert_key").agg(F.min(row_id).alias("_first"))
    held = stored_keys.select("alert_key").distinct().withColumn("_held", F.lit(True))
    marked = alerts.join(first, "alert_key", "left").join(held, "alert_key", "left")
    repeated = F.col("_held").isNotNull() | (F.col("_first") != F.col(row_id))
    out = skip_if(marked, repeated, "duplicate_alert").drop("_first", "_held")
    return out.withColumn(
        "alert_key", F.when(F.col("decision") == "alert", F.col("alert_key"))
    ).select(*alerts.columns)


def _sent_first() -> list[Column]:
    return [F.when(F.col("sent_at").isNotNull(), 0).otherwise(1).alias("_q")]


def demote_duplicates(
    signals: DataFrame, keys: Sequence[str] = ("strategy", "event_id", "selection")
) -> DataFrame:
    """Keep the first alert per key: sent before unsent, then earliest, then id."""
    alerts = signals.where(F.col("decision") == "alert")
    rank = F.struct(*_sent_first(), F.coalesce("sent_at", "created_at").alias("_t"), "signal_id")
    kept = alerts.groupBy(*keys).agg(F.min_by("signal_id", rank).alias("_kept"))
    marked = signals.join(kept, list(keys), "left")
    lost = (F.col("decision") == "alert") & (F.col("signal_id") != F.col("_kept"))
    return marked.withColumns(
        {
            "filter_reasons": F.when(lost, F.array(F.lit("duplicate_alert_migrated"))).otherwise(F.col("filter_reasons")),
            "decision": F.when(lost, "skip").otherwise(F.col("decision")),
            "alert_key": F.when(
                (F.col("decision") == "alert") & ~lost, F.concat_ws(":", *[F.col(key).cast("string") for key in keys])
            ),
        }
    ).select(*signals.columns, *([] if "alert_key" in signals.columns else ["alert_key"]))


def one_alert_per_event(
    signals: DataFrame, keys: Sequence[str] = ("strategy", "event_id")
) -> DataFrame:
    """Keep one undelivered alert per event; delivered ones stay for the record.

    Delivered before undelivered, then the largest value (nulls last), then the
    earliest, then id. Only the kept row carries the event's alert key.
    """
    alerts = signals.where(F.col("decision") == "alert")
    value = F.when(F.col("sent_at").isNull(), -F.col("value_percent"))
    rank = F.struct(
        *_sent_first(), F.coalesce(value, F.lit(float("inf"))).alias("_v"),
        F.coalesce("sent_at", "created_at").alias("_t"), "signal_id",
    )
    kept = alerts.groupBy(*keys).agg(F.min_by("signal_id", rank).alias("_kept"))
    marked = signals.join(kept, list(keys), "left")
    other = (F.col("decision") == "alert") & (F.col("signal_id") != F.col("_kept"))
    lost = other & F.col("sent_at").isNull()
    return marked.withColumns(
        {
            "filter_reasons": F.when(lost, F.array(F.lit("superseded_event_alert_migrated"))).otherwise(F.col("filter_reasons")),
            "decision": F.when(lost, "skip").otherwise(F.col("decision")),
            "alert_key": F.when(
                (F.col("decision") == "alert") & ~other, F.concat_ws(":", *[F.col(key).cast("string") for key in keys])
            ),
        }
    ).select(*signals.columns, *([] if "alert_key" in signals.columns else ["alert_key"]))


def expire(signals: DataFrame, now: Column) -> DataFrame:
    """Undelivered alerts past their start or expiry become skips."""
    late = F.col("sent_at").isNull() & (
        (F.col("started_at") <= now) | F.coalesce(F.col("expires_at") <= now, F.lit(False))
    )
    hit = (F.col("decision") == "alert") & late
    noted = F.array_contains("filter_reasons", "delivery_expired")
    return signals.withColumns(
        {
            "filter_reasons": F.when(
                hit & ~noted, F.array_append("filter_reasons", F.lit("delivery_expired"))
            ).otherwise(F.col("filter_reasons")),
            "decision": F.when(hit, "skip").otherwise(F.col("decision")),
            "alert_key": F.when(~hit, F.col("alert_key")),
        }
    )


def pending(
    signals: DataFrame, now: Column, *, limit: int = 50, window_minutes: float | None = None
) -> DataFrame:
    """Undelivered, unexpired alerts of future events, earliest start first."""
    waiting = signals.where(
        (F.col("decision") == "alert") & F.col("sent_at").isNull() & (F.col("started_at") > now)
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )
    if window_minutes is not None:
        latest = F.timestamp_micros(F.unix_micros(now) + int(window_minutes * 60_000_000))
        waiting = waiting.where(F.col("started_at") <= latest)
    return waiting.orderBy("started_at", "signal_id").limit(limit)


def with_stakes(signals: DataFrame) -> DataFrame:
    """Bankroll share and amount; skips are sized too."""
    percent = odds_fn.live_stake_percent(F.col("bet_multiplier"))
    return signals.withColumn("stake_percent", percent).withColumn(
        "stake_amount", odds_fn.live_stake_amount(F.col("stake_percent"))
    )
