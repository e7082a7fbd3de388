"""Upserts by natural key as aggregates over old and new rows, and append-only tables.

``max_by`` keeps the newest row per key and combines on the map side; no sort
and no merge support of the storage is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_latest(
    current: DataFrame | None, new: DataFrame, *, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per key, the one with the largest order columns."""
    rows = new if current is None else current.unionByName(new)
    values = F.struct(*[name for name in rows.columns if name not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, F.struct(*order)).alias("v")).select(
        *keys, "v.*"
    ).select(*rows.columns)


def upsert_results(current: DataFrame | None, new: DataFrame, *, key: str = "event_id") -> DataFrame:
    """Newest score per event, but the earliest time it was observed."""
    rows = new if current is None else current.unionByName(new)
    values = F.struct(*[name for name in rows.columns if name not in (key, "observed_at")])
    return rows.groupBy(key).agg(
        F.max_by(values, F.struct("received_at", "payload_id")).alias("v"),
        F.min("observed_at").alias("observed_at"),
    ).select(key, "v.*", "observed_at").select(*rows.columns)


def append_new(current: DataFrame | None, new: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet."""
    if current is None:
        return new
    stored = current.select(*[F.col(name).alias(f"_k_{name}") for name in keys])
    condition = F.lit(True)
    for name in keys:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return new.join(stored, condition, "left_anti")


def append_dated(rows: DataFrame, path: str, batch: int, *, at: str = "received_at") -> None:
    """Append a batch to the table under ``path``, one directory a received date.

    The batch's own directory is replaced, so a batch that is tried again, or
    replayed after a crash, leaves one copy; other batches are never touched.
    Rows are brought together by date, so that a task does not write a file for
    each date; adaptive execution splits a date that is large.
    """
    dated = rows.withColumn("received_date", F.to_date(at)).hint("rebalance", "received_date")
    dated.write.mode("overwrite").partitionBy("received_date").parquet(f"{path}/batch_id={batch}")


def read_dated(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a table; a filter on received_date or batch_id reads their directories alone."""
    return spark.read.parquet(path)
