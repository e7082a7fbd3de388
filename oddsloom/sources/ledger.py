"""Rejection ledger: invalid rows get a reason, valid rows go on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHOWN_REASONS = 20


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reason column, rejected rows)."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def runs(
    items: DataFrame, by: Sequence[str], *, position: str = "position", reason: str = "reject_reason",
    received: DataFrame | None = None,
) -> DataFrame:
    """One row per parser run: counts, status and the first reasons.

    ``received`` gives ``by`` and the number of entries of each payload, for
    sources whose payloads hold more than the items that are looked at.

    Reasons are ranked before they are collected, so a run in which everything
    fails still brings at most the shown number of them together.
    """
    counts = items.groupBy(*by).agg(
        F.count("*").alias("received"),
        F.count_if(F.col(reason).isNull()).alias("parsed"),
        F.count_if(F.col(reason).isNotNull()).alias("rejected"),
    )
    order = Window.partitionBy(*by).orderBy(position)
    shown = (
        items.where(F.col(reason).isNotNull())
        .select(*by, position, reason)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= SHOWN_REASONS)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(position, reason))).alias("first"))
        .select(*by, F.array_join(F.transform("first", lambda item: item[reason]), "; ").alias("last_error"))
    )
    status = F.when(F.col("rejected") > 0, "partial").otherwise("success")
    if received is not None:
        whole = received.groupBy(*by).agg(F.sum("received").alias("received"))
        zero = F.lit(0).cast("long")
        counts = whole.join(counts.drop("received"), list(by), "left").select(
            *by, "received", F.coalesce("parsed", zero).alias("parsed"), F.coalesce("rejected", zero).alias("rejected")
        )
    return counts.join(shown, list(by), "left").withColumn("status", status)
