"""Queries on point-in-time form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import asof, sessions
from oddsloom.plans import bindings
from oddsloom.plans.registry import query

LINES = ("1.5", "2.5", "3.5", "4.5", "5.5", "6.5")
RATES = ("win_rate", "draw_rate", "loss_rate", "goals_for_avg", "goals_against_avg", "total_avg",
         "median_total", "std_total", *[f"over_{x.replace('.', '_')}" for x in LINES],
         *[f"under_{x.replace('.', '_')}" for x in LINES])
SIZES = "SELECT unnest([5, 10, 20, 25, 30, 50, 75, 100, 200, 0]) AS last_n"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at fixed places, the precision results are compared at."""
    doubles = [field.name for field in df.schema if field.dataType.typeName() == "double"]
    return df.withColumns({name: _rounded(F.col(name), places) for name in doubles}) if doubles else df


def _rounded(value: Column, places: int) -> Column:
    """``round`` of a double. Away from halves and large values whole numbers do the same without decimals."""
    scaled = value * float(10**places)
    whole = F.floor(scaled + 0.5)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled + 0.5 - whole - 0.5) < 0.499)
    return F.when(plain, whole / float(10**places)).otherwise(F.round(value, places))


def _metrics_sql() -> str:
    lines = ",\n".join(
        f"""  round(coalesce(count(*) FILTER (WHERE p.gf + p.ga > {x}), 0) / greatest(count(p.rn), 1), 6) AS over_{x.replace('.', '_')},
  round(coalesce(count(*) FILTER (WHERE p.gf + p.ga < {x}), 0) / greatest(count(p.rn), 1), 6) AS under_{x.replace('.', '_')}"""
        for x in LINES
    )
    return f"""  count(p.rn) AS matches,
  count(*) FILTER (WHERE p.gf > p.ga) AS wins,
  count(*) FILTER (WHERE p.gf = p.ga) AS draws,
  count(*) FILTER (WHERE p.gf < p.ga) AS losses,
  round(count(*) FILTER (WHERE p.gf > p.ga) / greatest(count(p.rn), 1), 6) AS win_rate,
  round(count(*) FILTER (WHERE p.gf = p.ga) / greatest(count(p.rn), 1), 6) AS draw_rate,
  round(count(*) FILTER (WHERE p.gf < p.ga) / greatest(count(p.rn), 1), 6) AS loss_rate,
  round(coalesce(avg(p.gf), 0), 6) AS goals_for_avg,
  round(coalesce(avg(p.ga), 0), 6) AS goals_against_avg,
  round(coalesce(avg(p.gf + p.ga), 0), 6) AS total_avg,
  round(coalesce(median(p.gf + p.ga), 0), 6) AS median_total,
  round(coalesce(stddev_pop(p.gf + p.ga), 0), 6) AS std_total,
{lines}"""


SIDES = """h AS (
  SELECT event_id, started_at, available_at, sport, source, game, tournament_key, player1 AS player, score1 AS gf, score2 AS ga FROM matches
  UNION ALL
  SELECT event_id, started_at, available_at, sport, source, game, tournament_key, player2, score2, score1 FROM matches WHERE player1 <> player2),
t AS (SELECT *, 1 AS side, player1 AS player FROM matches UNION ALL SELECT *, 2 AS side, player2 AS player FROM matches)"""
ELIGIBLE = """h.sport = t.sport AND h.event_id <> t.event_id
  AND h.started_at < t.started_at AND h.available_at < t.started_at"""
LATEST = "ORDER BY h.started_at DESC, h.event_id DESC"
PLAYER_PAIRS = f"""p AS (
  SELECT t.event_id, t.side, h.gf, h.ga, h.started_at, t.started_at AS cutoff,
         row_number() OVER (PARTITION BY t.event_id, t.side {LATEST}) AS rn
  FROM t JOIN h ON h.player = t.player AND {ELIGIBLE})"""
DIRECTED = """d AS (
  SELECT event_id, started_at, available_at, sport, player1 AS one, player2 AS two, score1 AS gf, score2 AS ga, TRUE AS direct FROM matches
  UNION ALL
  SELECT event_id, started_at, available_at, sport, player2, player1, score2, score1, FALSE FROM matches WHERE player1 <> player2)"""
PAIR_PAIRS = f"""p AS (
  SELECT s.scope, t.event_id, h.gf, h.ga,
         row_number() OVER (PARTITION BY s.scope, t.event_id {LATEST}) AS rn
  FROM matches t
  JOIN d h ON h.one = t.player1 AND h.two = t.player2 AND {ELIGIBLE}
  JOIN (SELECT unnest(['h2h', 'h2h_same_direction']) AS scope) s ON s.scope = 'h2h' OR h.direct)"""


def _form(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return asof.last_n_form(
        bindings.matches(spark, sf_dir), bindings.match_targets(spark, sf_dir), **options
    )


@query("asof_player_form", f"""{bindings.with_views('matches')}, {SIDES}, {PLAYER_PAIRS}, w AS ({SIZES})
SELECT t.event_id, t.side, w.last_n,
{_metrics_sql()}
FROM t CROSS JOIN w LEFT JOIN p ON p.event_id = t.event_id AND p.side = t.side AND (w.last_n = 0 OR p.rn <= w.last_n)
GROUP BY t.event_id, t.side, w.last_n""")
def asof_player_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _form(spark, sf_dir, scopes=("global",))
    return rounded(form.drop("cutoff_at", "scope"))


_BUSY = "busy AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE player1 END AS player1) FROM matches)"


@query("asof_busy_player_form", f"""{bindings.with_views('matches')}, {_BUSY}, {SIDES.replace('FROM matches', 'FROM busy')}, {PLAYER_PAIRS}, w AS ({SIZES})
SELECT t.event_id, t.side, w.last_n,
{_metrics_sql()}
FROM t CROSS JOIN w LEFT JOIN p ON p.event_id = t.event_id AND p.side = t.side AND (w.last_n = 0 OR p.rn <= w.last_n)
GROUP BY t.event_id, t.side, w.last_n""")
def asof_busy_player_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a third of all matches on one player."""
    def busy(df: DataFrame) -> DataFrame:
        return df.withColumn("player1", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("player1")))

    form = asof.last_n_form(
        busy(bindings.matches(spark, sf_dir)), busy(bindings.match_targets(spark, sf_dir)), scopes=("global",)
    )
    return rounded(form.drop("cutoff_at", "scope"))


_SCOPED = ("source", "game", "tournament", "format")
_SCOPED_PAIRS = f"""p AS (
  SELECT s.scope, t.event_id, t.side, h.gf, h.ga,
         row_number() OVER (PARTITION BY s.scope, t.event_id, t.side {LATEST}) AS rn
  FROM t JOIN h ON h.player = t.player AND {ELIGIBLE}
  JOIN s ON s.scope = 'format' OR (s.scope = 'source' AND h.source = t.source) OR (s.scope = 'game' AND h.game = t.game)
    OR (s.scope = 'tournament' AND h.tournament_key IS NOT DISTINCT FROM t.tournament_key))"""


def _scoped_sql(sizes: str) -> str:
    return f"""{bindings.with_views('matches')}, {SIDES},
s AS (SELECT unnest(['source', 'game', 'tournament', 'format']) AS scope), {_SCOPED_PAIRS},
w AS ({sizes})
SELECT s.scope, t.event_id, t.side, w.last_n,
{_metrics_sql()}
FROM t CROSS JOIN s CROSS JOIN w
LEFT JOIN p ON p.scope = s.scope AND p.event_id = t.event_id AND p.side = t.side AND (w.last_n = 0 OR p.rn <= w.last_n)
GROUP BY s.scope, t.event_id, t.side, w.last_n"""


@query("asof_scoped_form_all_windows", _scoped_sql(SIZES))
@query("asof_scoped_form", _scoped_sql(SIZES))
def asof_scoped_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes compare null-safely: a null tournament or format equals a null one."""
    form = _form(spark, sf_dir, scopes=_SCOPED)
    return rounded(form.drop("cutoff_at"))


@query("asof_h2h_form", f"""{bindings.with_views('matches')}, {DIRECTED}, {PAIR_PAIRS}, w AS ({SIZES}),
s AS (SELECT unnest(['h2h', 'h2h_same_direction']) AS scope)
SELECT s.scope, t.event_id, w.last_n,
{_metrics_sql()}
FROM matches t CROSS JOIN s CROSS JOIN w
LEFT JOIN p ON p.scope = s.scope AND p.event_id = t.event_id AND (w.last_n = 0 OR p.rn <= w.last_n)
GROUP BY s.scope, t.event_id, w.last_n""")
def asof_h2h_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _form(spark, sf_dir, scopes=("h2h", "h2h_same_direction"))
    return rounded(form.drop("cutoff_at", "side"))


def with_teams(df: DataFrame) -> DataFrame:
    """Teams for the team scopes: missing on some rows, shared by the players."""
    return df.withColumns(
        {
            "team1": F.when(F.col("event_id") % 7 != 0, ((F.col("player1") + F.col("event_id")) % 2).cast("string")),
            "team2": F.when(F.col("event_id") % 5 != 0, ((F.col("player2") + F.col("event_id")) % 2).cast("string")),
        }
    )


_TEAMS = """m AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CAST((player1 + event_id) % 2 AS VARCHAR) END AS team1,
  CASE WHEN event_id % 5 <> 0 THEN CAST((player2 + event_id) % 2 AS VARCHAR) END AS team2 FROM matches)"""


def _team_sql(sizes: str) -> str:
    return f"""{bindings.with_views('matches')}, {_TEAMS},
g AS (
  SELECT event_id, started_at, available_at, sport, player1 AS one, team1 AS t1, player2 AS two, team2 AS t2, score1 AS gf, score2 AS ga FROM m
  UNION ALL
  SELECT event_id, started_at, available_at, sport, player2, team2, player1, team1, score2, score1 FROM m WHERE player1 <> player2),
k AS (
  SELECT 'player_team' AS scope, event_id, started_at, sport, 1 AS side, player1 AS one, team1 AS t1, NULL AS two, NULL AS t2 FROM m WHERE team1 IS NOT NULL
  UNION ALL SELECT 'player_team', event_id, started_at, sport, 2, player2, team2, NULL, NULL FROM m WHERE team2 IS NOT NULL
  UNION ALL SELECT 'player_team_h2h', event_id, started_at, sport, 0, player1, team1, player2, team2 FROM m WHERE team1 IS NOT NULL AND team2 IS NOT NULL),
p AS (
  SELECT t.scope, t.event_id, t.side, h.gf, h.ga,
         row_number() OVER (PARTITION BY t.scope, t.event_id, t.side {LATEST}) AS rn
  FROM k t JOIN g h ON h.one = t.one AND h.t1 = t.t1 AND {ELIGIBLE}
   AND (t.scope = 'player_team' OR (h.two = t.two AND h.t2 = t.t2))),
w AS ({sizes})
SELECT k.scope, k.event_id, k.side, w.last_n,
{_metrics_sql()}
FROM k CROSS JOIN w
LEFT JOIN p ON p.scope = k.scope AND p.event_id = k.event_id AND p.side = k.side AND (w.last_n = 0 OR p.rn <= w.last_n)
GROUP BY k.scope, k.event_id, k.side, w.last_n"""


@query("asof_team_form_all_windows", _team_sql(SIZES))
@query("asof_team_form", _team_sql(SIZES))
def asof_team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = asof.last_n_form(
        with_teams(bindings.matches(spark, sf_dir)),
        with_teams(bindings.match_targets(spark, sf_dir)),
        scopes=("player_team", "player_team_h2h"),
    )
    return rounded(form.drop("cutoff_at"))


_SESSION_SQL = f"""{bindings.with_views('matches')}, {SIDES}, {PLAYER_PAIRS},
gaps AS (SELECT *, CASE WHEN lag(started_at) OVER o - started_at > INTERVAL 45 MINUTE THEN 1 ELSE 0 END AS brk
  FROM p WINDOW o AS (PARTITION BY event_id, side ORDER BY rn)),
isle AS (SELECT *, sum(brk) OVER (PARTITION BY event_id, side ORDER BY rn) AS island,
  sum(CASE WHEN gf > ga THEN 0 ELSE 1 END) OVER (PARTITION BY event_id, side ORDER BY rn) AS not_win,
  sum(CASE WHEN gf = ga THEN 0 ELSE 1 END) OVER (PARTITION BY event_id, side ORDER BY rn) AS not_draw,
  sum(CASE WHEN gf < ga THEN 0 ELSE 1 END) OVER (PARTITION BY event_id, side ORDER BY rn) AS not_loss
  FROM gaps)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_form(bindings.matches(spark, sf_dir), bindings.match_targets(spark, sf_dir))


@query("session_features", f"""{_SESSION_SQL}
SELECT t.event_id, t.side,
  count(*) FILTER (WHERE i.cutoff - i.started_at <= INTERVAL 30 MINUTE) AS matches_last_30m,
  count(*) FILTER (WHERE i.cutoff - i.started_at <= INTERVAL 1 HOUR) AS matches_last_1h,
  count(*) FILTER (WHERE i.cutoff - i.started_at <= INTERVAL 3 HOUR) AS matches_last_3h,
  round(coalesce(min(epoch_us(i.cutoff) - epoch_us(i.started_at)) / 60e6, -1), 9) AS minutes_since_previous_game,
  count(*) FILTER (WHERE island = 0 AND gf > ga) AS wins,
  count(*) FILTER (WHERE island = 0 AND gf = ga) AS draws,
  count(*) FILTER (WHERE island = 0 AND gf < ga) AS losses,
  CAST(coalesce(sum(gf) FILTER (WHERE island = 0), 0) AS BIGINT) AS goals
FROM t LEFT JOIN isle i ON i.event_id = t.event_id AND i.side = t.side
GROUP BY t.event_id, t.side""")
def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _sessions(spark, sf_dir)
    return rounded(form.drop("cutoff_at", "consecutive_wins", "consecutive_draws", "consecutive_losses"), 9)


@query("streak_features", f"""{_SESSION_SQL}
SELECT t.event_id, t.side,
  count(*) FILTER (WHERE not_win = 0) AS consecutive_wins,
  count(*) FILTER (WHERE not_draw = 0) AS consecutive_draws,
  count(*) FILTER (WHERE not_loss = 0) AS consecutive_losses
FROM t LEFT JOIN isle i ON i.event_id = t.event_id AND i.side = t.side
GROUP BY t.event_id, t.side""")
def streak_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select(
        "event_id", "side", "consecutive_wins", "consecutive_draws", "consecutive_losses"
    )
