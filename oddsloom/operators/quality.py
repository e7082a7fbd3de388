"""Data-quality audit: duplicates, orphans and row contracts, from a list of checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """Groups of equal keys with more than one row."""

    name: str
    table: str
    keys: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Reference:
    """Rows whose parent does not exist; a null key counts unless optional."""

    name: str
    table: str
    key: str
    parent: str
    parent_key: str
    optional: bool = False


@dataclass(frozen=True)
class Contract:
    """Rows that break a condition, possibly over joined parents.

    ``joins`` lists (alias, table, left column, right column); columns of the
    checked table are plain, those of a joined one carry its alias.
    """

    name: str
    table: str
    broken: str
    joins: tuple[tuple[str, str, str, str], ...] = ()


CHECKS: tuple[Unique | Reference | Contract, ...] = (
    Unique("matched_source_duplicates", "event_matches", ("source_event_id",), "status = 'matched'"),
    Unique("matched_bookmaker_duplicates", "event_matches", ("bookmaker_event_id",), "status = 'matched'"),
    Unique("duplicate_alert_keys", "signals", ("alert_key",), "alert_key IS NOT NULL"),
    Unique("duplicate_events", "events", ("source_id", "external_id")),
    Unique("duplicate_event_match_pairs", "event_matches", ("source_event_id", "bookmaker_event_id")),
    Unique("duplicate_predictions", "model_predictions", ("odds_snapshot_id", "model_name", "model_version", "selection")),
    Unique("duplicate_signals", "signals", ("prediction_id",), "prediction_id IS NOT NULL"),
    Unique("duplicate_settlements", "settlements", ("signal_id",), "signal_id IS NOT NULL"),
    Reference("orphan_tournaments_source", "tournaments", "source_id", "sources", "id"),
    Reference("orphan_events_source", "events", "source_id", "sources", "id"),
    Reference("orphan_events_tournament", "events", "tournament_id", "tournaments", "id", True),
    Reference("orphan_events_player1", "events", "player1_id", "players", "id", True),
    Reference("orphan_events_player2", "events", "player2_id", "players", "id", True),
    Reference("orphan_events_team1", "events", "team1_id", "teams", "id", True),
    Reference("orphan_events_team2", "events", "team2_id", "teams", "id", True),
    Reference("orphan_event_participants_event", "event_participants", "event_id", "events", "id"),
    Reference("orphan_event_participants_player", "event_participants", "player_id", "players", "id", True),
    Reference("orphan_event_participants_team", "event_participants", "team_id", "teams", "id", True),
    Reference("orphan_results_event", "results", "event_id", "events", "id"),
    Reference("orphan_markets_event", "markets", "event_id", "events", "id"),
    Reference("orphan_odds_event", "odds_snapshots", "event_id", "events", "id"),
    Reference("orphan_odds_market", "odds_snapshots", "market_id", "markets", "id"),
    Reference("orphan_odds_bookmaker_source", "odds_snapshots", "bookmaker_source_id", "sources", "id"),
    Reference("orphan_event_matches_source", "event_matches", "source_event_id", "events", "id"),
    Reference("orphan_event_matches_bookmaker", "event_matches", "bookmaker_event_id", "events", "id"),
    Reference("orphan_predictions_event", "model_predictions", "event_id", "events", "id"),
    Reference("orphan_predictions_snapshot", "model_predictions", "odds_snapshot_id", "odds_snapshots", "id"),
    Reference("orphan_predictions_event_match", "model_predictions", "event_match_id", "event_matches", "id", True),
    Reference("orphan_signals_prediction", "signals", "prediction_id", "model_predictions", "id"),
    Reference("orphan_settlements_signal", "settlements", "signal_id", "signals", "id"),
    Reference("orphan_settlements_result", "settlements", "result_id", "results", "id"),
    Reference("orphan_corridors_source", "odds_corridors", "bookmaker_source_id", "sources", "id"),
    Reference("orphan_corridor_observations_match", "corridor_observations", "event_match_id", "event_matches", "id"),
    Reference("orphan_corridor_observations_snapshot", "corridor_observations", "odds_snapshot_id", "odds_snapshots", "id"),
    Reference("orphan_corridor_observations_market", "corridor_observations", "market_id", "markets", "id"),
    Reference("orphan_corridor_observations_result", "corridor_observations", "result_id", "results", "id"),
    Reference("orphan_corridor_observations_source", "corridor_observations", "bookmaker_source_id", "sources", "id"),
    Contract("results_without_availability_timestamp", "results",
             "settled_at IS NULL AND source_updated_at IS NULL AND observed_at IS NULL"),
    Contract("prediction_cutoff_after_creation", "model_predictions", "feature_cutoff_at > created_at"),
    Contract("signal_sent_before_creation", "signals", "sent_at < created_at"),
    Contract("result_score_contract_mismatch", "results",
             "total <> score1 + score2 OR (score1 > score2 AND winner <> 'P1') OR (score1 < score2 AND winner <> 'P2')"
             " OR (score1 = score2 AND winner <> 'X') OR (score1 = score2 AND NOT is_draw) OR (score1 <> score2 AND is_draw)"),
    Contract("results_on_non_history_source", "results", "s.source_type <> 'history'",
             (("e", "events", "event_id", "e.id"), ("s", "sources", "e.source_id", "s.id"))),
    Contract("odds_market_event_mismatch", "odds_snapshots", "m.event_id <> t.event_id",
             (("m", "markets", "market_id", "m.id"),)),
    Contract("invalid_odds_market_contracts", "odds_snapshots",
             "(m.code = 'total' AND (line IS NULL OR selection NOT IN ('over', 'under')))"
             " OR (m.code = '1x2' AND selection NOT IN ('P1', 'X', 'P2'))",
             (("m", "markets", "market_id", "m.id"),)),
    Contract("prediction_snapshot_event_mismatch", "model_predictions", "o.event_id <> t.event_id",
             (("o", "odds_snapshots", "odds_snapshot_id", "o.id"),)),
    Contract("wrong_event_match_roles", "event_matches", "hs.source_type <> 'history' OR bs.source_type <> 'bookmaker'",
             (("h", "events", "source_event_id", "h.id"), ("hs", "sources", "h.source_id", "hs.id"),
              ("b", "events", "bookmaker_event_id", "b.id"), ("bs", "sources", "b.source_id", "bs.id"))),
)


def duplicate_groups(df: DataFrame, keys: Sequence[str], where: Column | str | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(
    child: DataFrame, key: str, parent: DataFrame, parent_key: str, *, optional: bool = False
) -> DataFrame:
    """Child rows without a parent. A null key has none, unless it is optional."""
    rows = child.where(F.col(key).isNotNull()) if optional else child
    parents = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return rows.join(parents, F.col(key) == F.col("_parent"), "left_anti")


def broken_rows(tables: Mapping[str, DataFrame], check: Contract) -> DataFrame:
    rows = tables[check.table].alias("t")
    for alias, table, left, right in check.joins:
        left_column = left if "." in left else f"t.{left}"
        rows = rows.join(tables[table].alias(alias), F.expr(f"{left_column} = {right}"))
    return rows.where(check.broken)


def rows_of(tables: Mapping[str, DataFrame], check: Unique | Reference | Contract) -> DataFrame:
    if isinstance(check, Unique):
        return duplicate_groups(tables[check.table], check.keys, check.where)
    if isinstance(check, Reference):
        return orphans(
            tables[check.table], check.key, tables[check.parent], check.parent_key,
            optional=check.optional,
        )
    return broken_rows(tables, check)


def orphan_counts(tables: Mapping[str, DataFrame], checks: Sequence[Reference]) -> DataFrame:
    """name and n (child rows without a parent) of all reference checks, reading each table once.

    A table gives the keys it refers to, each under its check, and the keys that
    others refer to, under no check. All meet by (parent, key): counted per
    check before they move, so a key that most rows share moves as one row a
    task, and a group holds a row a check at most.
    """
    wanted = {(check.parent, check.parent_key) for check in checks}
    rows = None
    for name, table in tables.items():
        entries = []
        for check in (check for check in checks if check.table == name):
            key = F.col(check.key).cast("string")
            entry = F.struct(
                F.lit(f"{check.parent}.{check.parent_key}").alias("parent"), key.alias("key"), F.lit(check.name).alias("name")
            )
            entries.append(F.when(key.isNotNull(), entry) if check.optional else entry)
        for key in sorted(key for parent, key in wanted if parent == name):
            entry = F.struct(F.lit(f"{name}.{key}").alias("parent"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("name"))
            entries.append(F.when(F.col(key).isNotNull(), entry))
        if entries:
            own = table.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
            rows = own if rows is None else rows.unionByName(own)
    counted = rows.groupBy("parent", "key", "name").agg(F.count("*").alias("n"))
    met = counted.groupBy("parent", "key").agg(
        F.count_if(F.col("name").isNull()).alias("parents"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n"))).alias("held")
    )
    lost = met.where("parents = 0").select(F.explode("held").alias("c")).select("c.name", "c.n")
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(check.name) for check in checks])).alias("name"), F.lit(0).cast("long").alias("n"))
    return lost.unionByName(names).groupBy("name").agg(F.sum("n").alias("n"))


def audit(
    tables: Mapping[str, DataFrame],
    checks: Sequence[Unique | Reference | Contract] = CHECKS,
) -> DataFrame:
    """(kind, name, n): row counts of all tables and findings of all checks."""
    references = [check for check in checks if isinstance(check, Reference)]
    parts = [("rows", name, table) for name, table in tables.items()]
    parts += [("problem", check.name, rows_of(tables, check)) for check in checks if not isinstance(check, Reference)]
    out = None
    for kind, name, rows in parts:
        row = rows.agg(F.count("*").alias("n")).select(
            F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n"
        )
        out = row if out is None else out.unionByName(row)
    if references:
        found = orphan_counts(tables, references).select(F.lit("problem").alias("kind"), "name", "n")
        out = found if out is None else out.unionByName(found)
    return out


def is_healthy(report: DataFrame) -> DataFrame:
    """One row: healthy when no problem was counted."""
    problems = report.where("kind = 'problem'")
    return problems.agg((F.coalesce(F.max("n"), F.lit(0)) == 0).alias("healthy"))
