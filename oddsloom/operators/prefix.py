"""Running values over one ordered run without one task per run.

A run is cut into time buckets. Rows are scanned inside (run, bucket); the
bucket summaries, one row each, are scanned per run; then every bucket gets the
value it starts from. The largest window holds the buckets of a run, a number
bounded by its time span, not by its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_SECONDS = 3600


def with_bucket(df: DataFrame, at: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    width = bucket_seconds * 1_000_000
    return df.withColumn("_bucket", F.floor(F.unix_micros(at) / F.lit(width)).cast("long"))


def inside(run: Sequence[str], order: Sequence[str]):
    """Rows of one bucket up to the current one."""
    return Window.partitionBy(*run, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def earlier(run: Sequence[str]):
    """Buckets of the run before the current one."""
    return Window.partitionBy(*run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    df: DataFrame,
    *,
    run: Sequence[str],
    order: Sequence[str],
    at: str,
    values: Mapping[str, Column],
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add, for each name, the sum over the run's rows strictly before the row."""
    staged = with_bucket(df, at, bucket_seconds).withColumns(
        {f"_v_{name}": value for name, value in values.items()}
    )
    totals = staged.groupBy(*run, "_bucket").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    offsets = totals.select(
        *run, "_bucket",
        *[F.sum(f"_t_{name}").over(earlier(run)).alias(f"_o_{name}") for name in values],
    )
    here = inside(run, order)
    scanned = staged.withColumns(
        {f"_s_{name}": F.sum(f"_v_{name}").over(here) for name in values}
    )
    zero = F.lit(0)
    joined = scanned.join(offsets, [*run, "_bucket"])
    return joined.select(
        *df.columns,
        *[
            (
                F.coalesce(F.col(f"_o_{name}"), zero)
                + F.col(f"_s_{name}")
                - F.coalesce(F.col(f"_v_{name}"), zero)
            ).alias(name)
            for name in values
        ],
    )


def path_summary(
    df: DataFrame,
    *,
    run: Sequence[str],
    order: Sequence[str],
    at: str,
    profit: Column,
    won: Column,
    lost: Column,
    extra: Sequence[Column] = (),
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One row per (run, bucket) from which drawdown and streaks can be merged.

    ``profit`` is zero and ``won``/``lost`` are false on rows that are no
    settled bet. One sort serves all of it; ``extra`` aggregates ride along.
    """
    here = inside(run, order)
    scanned = with_bucket(df, at, bucket_seconds).withColumns(
        {"_gain": profit, "_won": won, "_lost": lost}
    )
    scanned = scanned.withColumns(
        {"_c": F.sum("_gain").over(here), "_l": F.count_if(F.col("_lost")).over(here)}
    )
    scanned = scanned.withColumns(
        {
            "_p": F.max("_c").over(here),
            "_at_win": F.max(F.when(F.col("_won"), F.col("_l"))).over(here),
        }
    )
    at_win = F.when(F.col("_won"), F.col("_l"))
    total = F.max("_l")
    return scanned.groupBy(*run, "_bucket").agg(
        F.sum("_gain").alias("_total"),
        F.max("_c").alias("_high"),
        F.min("_c").alias("_low"),
        F.max(F.col("_p") - F.col("_c")).alias("_fall"),
        F.max(F.col("_l") - F.coalesce("_at_win", F.lit(0))).alias("_best"),
        F.coalesce(F.min(at_win), total).alias("_leading"),
        (total - F.coalesce(F.max(at_win), F.lit(0))).alias("_trailing"),
        F.count_if(F.col("_won")).alias("_wins"),
        *extra,
    )


def merge_paths(
    summary: DataFrame, *, run: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Largest fall from the running peak (peak >= 0) and longest losing streak.

    A losing streak ends at a win; buckets without a win prolong the streak
    that the last win left behind.
    """
    before = earlier(run)
    ordered = Window.partitionBy(*run).orderBy("_bucket")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = summary.withColumns(
        {
            "_start": F.coalesce(F.sum("_total").over(before), F.lit(0.0)),
            "_epoch": F.count_if(F.col("_wins") > 0).over(up_to),
        }
    )
    in_epoch = Window.partitionBy(*run, "_epoch").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = placed.withColumns(
        {
            "_peak": F.max(F.col("_start") + F.col("_high")).over(before),
            "_open": F.sum("_trailing").over(in_epoch),
        }
    )
    peak = F.greatest(F.coalesce(F.col("_peak"), F.lit(0.0)), F.lit(0.0))
    fall = F.greatest(F.col("_fall"), peak - (F.col("_start") + F.col("_low")), F.lit(0.0))
    incoming = F.coalesce(F.lag("_open").over(ordered), F.lit(0))
    staged = placed.withColumns(
        {"_deep": fall, "_reach": F.greatest("_best", incoming + F.col("_leading"))}
    )
    return staged.groupBy(*run).agg(
        F.max("_deep").alias("max_drawdown"),
        F.max("_reach").alias("longest_losing_streak"),
        *extra,
    )
