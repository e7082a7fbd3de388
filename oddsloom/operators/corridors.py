"""Historical return by odds bucket: observations, buckets, lookup, publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.functions import clock, settlement
from oddsloom.functions import odds as odds_fn
from oddsloom.operators import quotes as quote_ops

GROUP = ("bookmaker", "sport", "game_key", "market", "selection", "line")
OBSERVATION_KEY = ("match_id", "market", "selection", "line")


def closing_observations(
    matches: DataFrame,
    source_events: DataFrame,
    book_events: DataFrame,
    results: DataFrame,
    quotes: DataFrame,
    *,
    as_of: Column,
    max_age_seconds: float = 900,
) -> DataFrame:
    """One settled closing quote per (match, market, selection, line).

    ``matches``: match_id, source_event_id, book_event_id, status,
    reversed_sides. ``source_events``: event_id, source_type. ``book_events``:
    event_id, started_at, sport, game, family, source_type, bookmaker.
    ``results``: event_id, score1, score2, observed_at, source_updated_at,
    settled_at. ``quotes``: book_event_id, snapshot_id, market, selection,
    line, odds, received_at.

    Quotes are reduced to the last one before kickoff before the joins with
    results and sources, so the wide rows are one per contract.
    """
    matched = matches.where(F.col("status") == "matched").select(
        "match_id", "source_event_id", "book_event_id", "reversed_sides"
    )
    history = source_events.where(F.col("source_type") == "history").select(
        F.col("event_id").alias("source_event_id")
    )
    books = book_events.where(
        (F.col("source_type") == "bookmaker") & (F.col("started_at") <= as_of)
    ).select(
        F.col("event_id").alias("book_event_id"), F.col("started_at").alias("kickoff"), "sport",
        F.coalesce("game", F.lit("")).alias("game_key"),
        F.coalesce("family", F.lit("")).alias("family"), "bookmaker",
    )
    available = clock.preferred_available(
        F.col("observed_at"), F.col("source_updated_at"), F.col("settled_at")
    )
    known = (
        results.withColumn("result_available_at", available)
        .where(F.col("result_available_at") <= as_of)
        .select(F.col("event_id").alias("source_event_id"), "score1", "score2", "result_available_at")
    )
    pairs = (
        matched.join(books, "book_event_id")
        .join(history, "source_event_id", "left_semi")
        .join(known, "source_event_id")
    )
    timed = quotes.join(pairs.select("book_event_id", "kickoff").distinct(), "book_event_id")
    closing = quote_ops.closing_quotes(
        quote_ops.canonical(timed),
        ("book_event_id", "market", "selection", "line"),
        max_age_seconds,
    ).drop("kickoff", "raw_selection")
    joined = closing.join(pairs, "book_event_id")
    s1, s2 = settlement.orient(F.col("score1"), F.col("score2"), F.col("reversed_sides"))
    oriented = joined.withColumns({"score1": s1, "score2": s2})
    return settlement.settle(oriented).where(F.col("outcome").isNotNull()).select(
        "match_id", "bookmaker", "sport", "game_key", "family", "market", "selection", "line",
        "odds", "outcome", "snapshot_id", F.col("received_at").alias("odds_received_at"),
        "reversed_sides", "result_available_at",
    )


def merge_with_changes(
    current: DataFrame, fresh: DataFrame, matched_ids: DataFrame, *, as_of: Column
) -> DataFrame:
    """Observation table after a rebuild, ``old`` (its row before) and ``change``.

    A change is created, updated (found again, changed or not), invalidated (its
    match is no longer matched) or null. Nothing is deleted.
    """
    keys = list(OBSERVATION_KEY)
    values = [name for name in fresh.columns if name not in keys]
    kept = [name for name in current.columns if name not in keys]
    none_old = F.lit(None).cast(current.select(F.struct(*kept).alias("s")).schema["s"].dataType)
    none_new = F.lit(None).cast(fresh.select(F.struct(*values).alias("s")).schema["s"].dataType)
    # Grouping treats null lines as equal, which a join on the key would not.
    both = fresh.select(*keys, F.struct(*values).alias("new"), none_old.alias("old")).unionByName(
        current.select(*keys, none_new.alias("new"), F.struct(*kept).alias("old"))
    )
    merged = both.groupBy(*keys).agg(
        F.first("new", ignorenulls=True).alias("new"), F.first("old", ignorenulls=True).alias("old")
    )
    alive = matched_ids.select("match_id").distinct().withColumn("_alive", F.lit(True))
    joined = merged.join(alive, "match_id", "left")
    was_active = F.coalesce("old.is_active", F.lit(False))
    active = F.col("new").isNotNull() | (was_active & F.col("_alive").isNotNull())
    return joined.select(
        *keys,
        *[F.coalesce(f"new.{name}", f"old.{name}").alias(name) for name in values],
        active.alias("is_active"),
        F.coalesce("old.created_at", as_of).alias("created_at"),
        F.when(~active, F.coalesce("old.invalidated_at", as_of)).alias("invalidated_at"),
        "old",
        F.when(F.col("new").isNotNull(), F.when(F.col("old").isNull(), "created").otherwise("updated"))
        .when(was_active & ~active, "invalidated").alias("change"),
    )


def merge_observations(
    current: DataFrame, fresh: DataFrame, matched_ids: DataFrame, *, as_of: Column
) -> DataFrame:
    """Observation table after a rebuild: replaced by key, never deleted.

    Rows of matches that are no longer matched stay, marked inactive.
    """
    return merge_with_changes(current, fresh, matched_ids, as_of=as_of).drop("old", "change")


def change_statistics(merged: DataFrame) -> DataFrame:
    """One row of counts over :func:`merge_with_changes`."""
    return merged.agg(
        F.count_if(F.col("change").isin("created", "updated")).alias("observations_materialized"),
        *[F.count_if(F.col("change") == name).alias(f"observations_{name}") for name in ("created", "updated", "invalidated")],
    )


_TOTALS = ("sample_size", "wins", "returns", "odds_total", "implied_total", "profit_total")


def totals(
    observations: DataFrame, *, group: Sequence[str] = GROUP, family: str = "family", width: str = "0.25", sign: str | None = None
) -> DataFrame:
    """Sums per bucket of the whole market and of each tournament family; ``sign`` names a column of 1 and -1.

    Sums of fixed-scale decimals, combined on the map side: the result does not
    depend on the partitioning, a bucket with most rows costs one partial row
    per task, and rows taken back leave the sums as if they had never been in.
    """
    price = F.col("odds").cast("decimal(12,5)")
    whole = F.struct(F.lit("global").alias("scope_type"), F.lit("").alias("scope_value"))
    narrow = F.struct(F.lit("tournament_family").alias("scope_type"), F.col(family).alias("scope_value"))
    scopes = F.when(F.coalesce(F.col(family), F.lit("")) == "", F.array(whole)).otherwise(
        F.array(whole, narrow)
    )
    times = (F.col(sign) if sign else F.lit(1)).cast("int")
    rows = observations.where(price > 1).select(
        *group, F.explode(scopes).alias("s"), "outcome", price.alias("odds"), times.alias("sign"),
        odds_fn.bucket_index(price, width).alias("bucket"),
        odds_fn.implied(price).alias("implied"),
        settlement.unit_profit(F.col("outcome"), price).alias("profit"),
    )

    def signed(name: str) -> Column:
        value = F.col(name)
        return F.sum(F.when(F.col("sign") < 0, -value).otherwise(value)).alias(f"{name}_total")

    return rows.groupBy(*group, F.col("s.scope_type").alias("scope_type"), F.col("s.scope_value").alias("scope_value"), "bucket").agg(
        F.sum("sign").alias("sample_size"),
        F.sum(F.when(F.col("outcome") == "win", F.col("sign")).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("outcome") == "return", F.col("sign")).otherwise(0)).alias("returns"),
        signed("odds"), signed("implied"), signed("profit"),
    )


def refresh_totals(
    held: DataFrame, merged: DataFrame, *, group: Sequence[str] = GROUP, family: str = "family", width: str = "0.25"
) -> DataFrame:
    """Bucket sums ``held`` before a merge, brought up to date from its changed observations alone."""
    values = [name for name in ("odds", "outcome", family, *group) if name not in OBSERVATION_KEY]
    keys = [name for name in OBSERVATION_KEY if name in group]
    before = merged.where("change IS NOT NULL AND old.is_active").select(*keys, *[F.col(f"old.{name}").alias(name) for name in values], F.lit(-1).alias("sign"))
    after = merged.where("change IS NOT NULL AND is_active").select(*keys, *values, F.lit(1).alias("sign"))
    delta = totals(before.unionByName(after), group=group, family=family, width=width, sign="sign")
    key = [*group, "scope_type", "scope_value", "bucket"]
    summed = held.unionByName(delta).groupBy(*key).agg(*[F.sum(name).alias(name) for name in _TOTALS])
    return summed.where("sample_size > 0")


def build(
    observations: DataFrame,
    *,
    group: Sequence[str] = GROUP,
    family: str = "family",
    width: str = "0.25",
    min_samples: int = 20,
) -> DataFrame:
    """Bucket metrics for the whole market and for each tournament family."""
    return metrics(totals(observations, group=group, family=family, width=width), group=group, width=width, min_samples=min_samples)


def metrics(
    sums: DataFrame, *, group: Sequence[str] = GROUP, width: str = "0.25", min_samples: int = 20
) -> DataFrame:
    """Rates of the buckets with samples enough, from their sums."""
    if min_samples <= 0:
        raise ValueError("min_samples must be positive")
    totals = sums.where(F.col("sample_size") >= min_samples).withColumns(
        {name: F.col(name).cast("double") for name in ("odds_total", "implied_total", "profit_total")}
    )
    n, wins = F.col("sample_size"), F.col("wins")
    return totals.select(
        *group, "scope_type", "scope_value", "bucket",
        odds_fn.bucket_low(F.col("bucket"), width).alias("odds_min"),
        odds_fn.bucket_high(F.col("bucket"), width).alias("odds_max"),
        "sample_size", "wins", (n - wins - F.col("returns")).alias("losses"), "returns",
        (wins / n).alias("win_rate"),
        (F.col("odds_total") / n).alias("average_odds"),
        (F.col("implied_total") / n).alias("average_implied_probability"),
        (F.col("profit_total") / n * 100.0).alias("roi_percent"),
        ((wins / n - F.col("implied_total") / n) * 100.0).alias("edge_percent"),
        odds_fn.corridor_confidence(wins, n).alias("confidence"),
    )


def with_verdict(corridors: DataFrame) -> DataFrame:
    return corridors.withColumn(
        "verdict",
        odds_fn.corridor_verdict(F.col("sample_size"), F.col("roi_percent"), F.col("edge_percent")),
    )


def lookup(
    probes: DataFrame,
    corridors: DataFrame,
    *,
    probe_id: str,
    group: Sequence[str] = GROUP,
    family: str = "family",
    width: str = "0.25",
    min_samples: int | str = 20,
) -> DataFrame:
    """Bucket that applies to each probe, the family's own before the global one.

    ``min_samples`` is a number or the probe column that holds it.

    The range test becomes an equality: the probe computes its bucket number.
    Each probe asks for two keys at most, so nothing is compared twice. When
    both sides carry clocks (``cutoff_at``, ``as_of``) later buckets are hidden.
    Probes without a bucket keep null corridor columns.
    """
    if isinstance(min_samples, int) and min_samples <= 0:
        raise ValueError("min_samples must be positive")
    least = F.lit(min_samples) if isinstance(min_samples, int) else F.col(min_samples)
    wanted = F.array(
        F.struct(F.lit("tournament_family").alias("scope_type"), F.coalesce(F.col(family), F.lit("")).alias("scope_value")),
        F.struct(F.lit("global").alias("scope_type"), F.lit("").alias("scope_value")),
    )
    asked = probes.where(F.col("odds") > 1).select(
        probe_id, *group, *(["cutoff_at"] if "cutoff_at" in probes.columns else []),
        odds_fn.bucket_index(F.col("odds"), width).alias("bucket"), least.alias("_least"),
        F.explode(wanted).alias("w"),
    ).select("*", "w.scope_type", "w.scope_value").drop("w")
    usable = corridors
    if "is_active" in corridors.columns:
        usable = usable.where("is_active")
    keys = [*group, "bucket", "scope_type", "scope_value"]
    found = [name for name in usable.columns if name not in (*group, "bucket")]
    offered = usable.select(
        *[F.col(name).alias(f"_k_{name}") for name in keys], F.struct(*found).alias("c")
    )
    condition = F.col("c.sample_size") >= F.col("_least")
    for name in keys:
        left, right = F.col(name), F.col(f"_k_{name}")
        condition = condition & (left.eqNullSafe(right) if name == "line" else left == right)
    if "cutoff_at" in probes.columns and "as_of" in corridors.columns:
        condition = condition & (F.col("c.as_of") <= F.col("cutoff_at"))
    hits = asked.join(offered, condition).select(probe_id, "c")
    rank = F.struct(
        (F.col("c.scope_type") == "tournament_family").cast("int"), F.col("c.sample_size")
    )
    best = hits.groupBy(probe_id).agg(F.max_by("c", rank).alias("c"))
    return probes.join(best, probe_id, "left").select(
        *probes.columns, *[F.col(f"c.{name}").alias(f"corridor_{name}") for name in found]
    )


def top(corridors: DataFrame, k: int = 30, min_samples: int = 20) -> DataFrame:
    """Best buckets by return, then depth; the key breaks remaining ties."""
    if k <= 0 or min_samples <= 0:
        raise ValueError("k and min_samples must be positive")
    usable = corridors.where(F.col("sample_size") >= min_samples)
    if "is_active" in corridors.columns:
        usable = usable.where("is_active")
    identity = [name for name in ("market", "selection", "line", "scope_type", "scope_value", "bucket")
                if name in corridors.columns]
    return usable.orderBy(F.desc("roi_percent"), F.desc("sample_size"), *identity).limit(k)


def publish(current: DataFrame, rebuilt: DataFrame, *, as_of: Column, key: Sequence[str]) -> DataFrame:
    """Bucket table after a rebuild at ``as_of``.

    Rebuilt buckets replace their key, all others are retired but kept. A
    rebuild older than the newest active bucket fails the job.
    """
    newest = current.where("is_active").agg(F.max("as_of")).scalar()
    backwards = newest > as_of
    stamped = rebuilt.withColumns(
        {
            "as_of": F.when(
                backwards, F.raise_error(F.lit("as_of cannot move a corridor backwards")).cast("timestamp")
            ).otherwise(as_of),
            "is_active": F.lit(True),
            "retired_at": F.lit(None).cast("timestamp"),
        }
    )
    retired = current.withColumn(
        "retired_at", F.when(F.col("is_active"), as_of).otherwise(F.col("retired_at"))
    ).withColumn("is_active", F.lit(False))
    both = stamped.unionByName(retired.select(*stamped.columns))
    newest_first = Window.partitionBy(*key).orderBy(F.desc("is_active"), F.desc("as_of"))
    return both.withColumn("_n", F.row_number().over(newest_first)).where("_n = 1").drop("_n")


def build_statistics(observations: DataFrame, corridors: DataFrame) -> DataFrame:
    """One row of rebuild counts."""
    seen = observations.agg(
        F.count("*").alias("observations"),
        F.count_if(F.col("outcome") == "return").alias("observations_returned"),
    )
    written = corridors.agg(
        F.count("*").alias("buckets_written"),
        F.count_if(F.col("scope_type") == "global").alias("global_buckets"),
        F.count_if(F.col("scope_type") != "global").alias("tournament_buckets"),
    )
    return seen.select(
        "*",
        *[written.select(name).scalar().alias(name) for name in written.columns],
    )
