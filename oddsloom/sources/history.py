"""Match-history sources A, B and C: nested payloads to flat tables.

Input rows are payloads with ``payload_id``, ``received_at`` and ``body``
(text). Each parser returns ``items`` (every element with its position and
reject reason), ``rejects`` and the valid rows. An element that cannot be read
is a ledger row, never a failed batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom import schemas
from oddsloom.functions import clock
from oddsloom.functions import text as text_fn

# Finished status of source A, states of B, mappings of B and C.
FINISHED_STATUS = 3
KNOWN_STATES = ("scheduled", "live", "finished", "cancelled")
B_SPORTS = {"efootball": ("football", "efootball"), "ehockey": ("hockey", "ehockey")}
C_SPORTS = {
    "fifa": ("football", "esoccer"),
    "nba": ("basketball", "nba2k"),
    "nfl": ("american_football", "madden"),
}
ENDED = "MATCH_ENDED"


def _score(value: Column) -> Column:
    """Non-negative whole number, else null."""
    number = F.trim(value.cast("string")).try_cast("int")
    return F.when(number >= 0, number)


def _reason(label: str, missing: Column, position: str = "position") -> Column:
    prefix = F.concat(F.lit(f"{label}["), F.col(position).cast("string"))
    return F.when(F.col("r").isNull(), F.concat(prefix, F.lit("] is not an object"))).when(
        missing, F.concat(prefix, F.lit("] has invalid core fields"))
    )


def _all_null(*columns: Column) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | column.isNull()
    return test


def _split(items: DataFrame, label: str, required: list[str]) -> dict[str, DataFrame]:
    missing = _all_null(*[F.col(name) for name in required])
    marked = items.withColumn("reject_reason", _reason(label, missing)).drop("r")
    ledger = ["payload_id", "received_at", "position", "reject_reason"]
    return {
        "rows": marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        "rejects": marked.where(F.col("reject_reason").isNotNull()).select(*ledger),
        "items": marked.select(*ledger),
    }


def _with_unreadable(out: dict[str, DataFrame], payloads: DataFrame, readable: Column, label: str) -> dict[str, DataFrame]:
    """Add a reject for each payload that cannot be read, so that none leaves without a trace."""
    lost = payloads.where(~F.coalesce(readable, F.lit(False))).select(
        "payload_id", "received_at", F.lit(None).cast("int").alias("position"),
        F.lit(f"{label} payload cannot be read").alias("reject_reason"),
    )
    return {**out, "rejects": out["rejects"].unionByName(lost), "items": out["items"].unionByName(lost)}


def _results(events: DataFrame, updated: Column | None = None) -> DataFrame:
    """Scores of finished events with the clocks that tell when they were known."""
    finished = events.where((F.col("status") == "finished") & F.col("score1").isNotNull() & F.col("score2").isNotNull())
    none = F.lit(None).cast("timestamp")
    return finished.select(
        "payload_id", "event_id", "score1", "score2", *result_columns(),
        none.alias("settled_at"),
        (updated if updated is not None else none).alias("source_updated_at"),
        F.col("received_at").alias("observed_at"),
    )


def result_columns() -> list[Column]:
    """Winner, draw flag and total of score1 and score2."""
    s1, s2 = F.col("score1"), F.col("score2")
    return [
        F.when(s1 > s2, "P1").when(s2 > s1, "P2").otherwise("X").alias("winner"),
        (s1 == s2).alias("is_draw"),
        (s1 + s2).alias("total"),
    ]


def parse_a_page(payloads: DataFrame) -> dict[str, DataFrame]:
    """Tournament references of source A and the page count."""
    read = payloads.select("payload_id", "received_at", F.from_json("body", schemas.HISTORY_A_PAGE).alias("j"))
    readable = F.col("j.tournaments").isNotNull() & (F.col("j.totalPages") >= 1)
    good = read.where(readable)
    rows = good.select("payload_id", "received_at", F.posexplode("j.tournaments").alias("position", "r")).select(
        "payload_id", "received_at", "position", "r",
        F.col("r.id").cast("string").alias("tournament_id"), F.col("r.status_id").alias("status_id"),
        text_fn.first_text(F.col("r.token_international"), F.col("r.token")).alias("name"),
    )
    out = _split(rows, "tournament", ["tournament_id", "status_id", "name"])
    out = _with_unreadable(out, read, readable, "tournament page")
    out["pages"] = good.select("payload_id", F.col("j.totalPages").alias("total_pages"))
    return out


def parse_a_matches(payloads: DataFrame) -> dict[str, DataFrame]:
    """Matches of one tournament per payload.

    Payloads carry two texts: ``tournament`` and ``body`` (the match array).
    A match is finished when its status says so and both scores are known.
    """
    read = payloads.select(
        "payload_id", "received_at",
        F.from_json("tournament", schemas.HISTORY_A_TOURNAMENT).alias("t"),
        F.from_json("body", schemas.HISTORY_A_MATCHES).alias("m"),
    )
    name = text_fn.first_text(F.col("t.token_international"), F.col("t.token"))
    headed = read.select(
        "payload_id", "received_at", F.col("t.id").cast("string").alias("tournament_id"),
        F.col("t.status_id").alias("tournament_status"), name.alias("tournament_name"), "m",
    )
    known = ~_all_null(F.col("tournament_id"), F.col("tournament_status"), F.col("tournament_name"))
    every, headed = headed, headed.where(known)

    def participant(side: int) -> dict[str, Column]:
        p = F.col(f"r.participant{side}")
        nickname = F.trim(p["nickname"])
        team = text_fn.first_text(p["team"]["token_international"], p["team"]["token"])
        return {
            f"player_key{side}": F.when(p["id"].isNotNull() & (nickname != ""), nickname),
            f"participation_id{side}": p["id"].cast("string"),
            f"team_name{side}": team,
            f"team_key{side}": F.when(team.isNotNull(), p["team"]["id"].cast("string")),
            f"score{side}": p["score"].cast("int"),
        }

    rows = headed.select("*", F.posexplode("m").alias("position", "r")).drop("m").withColumns(
        {
            "event_id": F.col("r.id").cast("string"),
            "status_id": F.col("r.status_id"),
            "started_at": clock.from_iso_with_offset(F.col("r.date")),
            **participant(1), **participant(2),
        }
    )
    final = (F.col("status_id") == FINISHED_STATUS) & F.col("score1").isNotNull() & F.col("score2").isNotNull()
    rows = rows.withColumn("status", F.when(final, "finished").otherwise("unknown"))
    out = _split(rows, "match", ["event_id", "status_id", "started_at", "player_key1", "player_key2"])
    out = _with_unreadable(out, every, known & F.col("m").isNotNull(), "tournament matches")
    events = out["rows"].withColumns({"sport": F.lit("football"), "game": F.lit("efootball")})
    tournaments = headed.select("payload_id", "received_at", "tournament_id", F.col("tournament_name").alias("name"), F.col("tournament_status").alias("status_id"))
    return {**out, "events": events, "results": _results(events), "tournaments": tournaments}


def parse_b_page(payloads: DataFrame, items_per_page: int) -> dict[str, DataFrame]:
    """Tours of source B and the number of pages."""
    if items_per_page <= 0:
        raise ValueError("items_per_page must be positive")
    read = payloads.select("payload_id", "received_at", F.from_json("body", schemas.HISTORY_B_PAGE).alias("j"))
    total = F.trim("j.total_items").try_cast("bigint")
    readable = F.col("j.items").isNotNull() & total.isNotNull()
    good = read.where(readable)
    rows = good.select("payload_id", "received_at", F.posexplode("j.items").alias("position", "r")).select(
        "payload_id", "received_at", "position", "r",
        text_fn.first_text(F.col("r.id")).alias("route_id"),
        text_fn.first_text(F.col("r.id_sl")).alias("tournament_id"),
        text_fn.first_text(F.col("r.title_en"), F.col("r.title_ru")).alias("name"),
        F.lower(text_fn.first_text(F.col("r.state"))).alias("state"),
        text_fn.first_text(F.col("r.country")).alias("country"),
    )
    out = _split(rows, "tour", ["route_id", "tournament_id", "name", "state"])
    out = _with_unreadable(out, read, readable, "tour page")
    out["pages"] = good.select(
        "payload_id", total.alias("total_items"), F.ceil(total / items_per_page).alias("total_pages")
    )
    return out


def parse_b_games(payloads: DataFrame, *, zone: str, sport: str) -> dict[str, DataFrame]:
    """Games of one tour per payload; starts are wall clock of ``zone``.

    An update stamped at or before the start is creation time and is dropped.
    """
    if sport not in B_SPORTS:
        raise ValueError(f"sport must be one of {sorted(B_SPORTS)}")
    read = payloads.select("payload_id", "received_at", F.from_json("body", schemas.HISTORY_B_GAMES).alias("j"))
    games = read.where(F.col("j.tour_blocks.games").isNotNull())

    def participant(side: int) -> dict[str, Column]:
        english = text_fn.first_text(F.col(f"r.team_{side}_title_en"))
        russian = text_fn.first_text(F.col(f"r.team_{side}_title_ru"))
        team = F.coalesce(english, russian)
        return {
            f"player_key{side}": text_fn.first_text(F.col(f"r.player_{side}_id_sl"), F.col(f"r.player{side}_id")),
            f"player_name{side}": text_fn.first_text(
                F.col(f"r.player_{side}_title_en"), F.col(f"r.player_{side}_title_ru")
            ),
            f"team_key{side}": text_fn.first_text(F.col(f"r.team_{side}_id_sl"), F.col(f"r.team{side}_id")),
            f"team_name{side}": team,
            f"team_alternate{side}": F.when(russian != team, russian),
            f"score{side}": _score(F.col(f"r.score_team{side}")),
        }

    state = F.lower(text_fn.first_text(F.col("r.state")))
    rows = games.select("payload_id", "received_at", F.posexplode("j.tour_blocks.games").alias("position", "r")).withColumns(
        {
            "event_id": text_fn.first_text(F.col("r.id_sl"), F.col("r.id")),
            "started_at": clock.from_local(F.col("r.date_time"), zone),
            "state": state,
            **participant(1), **participant(2),
            "updated": clock.from_utc_text(F.col("r.updated_at")),
        }
    )
    rows = rows.withColumns(
        {
            "status": F.when(F.col("state").isin(*KNOWN_STATES), F.col("state")).otherwise("unknown"),
            "source_updated_at": clock.update_after_start(F.col("updated"), F.col("started_at")),
        }
    ).drop("updated")
    required = ["event_id", "started_at", "state"] + [
        f"{name}{side}" for side in (1, 2) for name in ("player_key", "player_name", "team_key", "team_name")
    ]
    out = _with_unreadable(_split(rows, "game", required), read, F.col("j.tour_blocks.games").isNotNull(), "tour")
    kind, game = B_SPORTS[sport]
    events = out["rows"].drop("state").withColumns({"sport": F.lit(kind), "game": F.lit(game)})
    return {**out, "events": events, "results": _results(events, F.col("source_updated_at"))}


def parse_c_schedule(payloads: DataFrame, *, api_sport: str) -> dict[str, DataFrame]:
    """Daily schedule of source C."""
    if api_sport not in C_SPORTS:
        raise ValueError(f"api_sport must be one of {sorted(C_SPORTS)}")
    read = payloads.select("payload_id", "received_at", F.from_json("body", schemas.HISTORY_C_SCHEDULE).alias("j"))
    texts = {
        "event_id": "externalId", "team_name1": "teamAName", "team_name2": "teamBName",
        "player_key1": "participantAName", "player_key2": "participantBName",
        "tournament_name": "tournamentName", "stream_name": "streamName",
    }
    rows = read.where(F.col("j").isNotNull()).select(
        "payload_id", "received_at", F.posexplode("j").alias("position", "r")
    ).withColumns(
        {
            **{name: text_fn.first_text(F.col(f"r.{field}")) for name, field in texts.items()},
            "started_at": clock.from_iso_with_offset(F.col("r.startDate")),
            "score1": _score(F.col("r.teamAScore")),
            "score2": _score(F.col("r.teamBScore")),
            "source_status": text_fn.first_text(F.col("r.matchStatus")),
            "cancelled": F.coalesce(F.col("r.isCancelled"), F.lit(False)),
        }
    )
    both = F.col("score1").isNotNull() & F.col("score2").isNotNull()
    neither = F.col("score1").isNull() & F.col("score2").isNull()
    status = (
        F.when(F.col("cancelled"), "cancelled")
        .when((F.col("source_status") == ENDED) & both, "finished")
        .when(F.col("source_status").isNull() & neither, "scheduled")
        .otherwise("unknown")
    )
    out = _split(rows.withColumn("status", status).drop("source_status", "cancelled"), "match", [*texts, "started_at"])
    out = _with_unreadable(out, read, F.col("j").isNotNull(), "schedule")
    sport, game = C_SPORTS[api_sport]
    events = text_fn.normalize_names(out["rows"], "tournament_name", output="_folded")
    events = events.withColumns(
        {
            "tournament_id": text_fn.tournament_key(F.lit(api_sport), F.col("_folded")),
            "sport": F.lit(sport), "game": F.lit(game),
        }
    ).drop("_folded")
    tournaments = events.groupBy("tournament_id").agg(F.min("tournament_name").alias("name"))
    return {**out, "events": events, "results": _results(events), "tournaments": tournaments}


def first_finished(tours: DataFrame, limit: int, state: str = "state", finished: str = "finished") -> DataFrame:
    """Finished tours of each payload, the first ``limit`` in payload order."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("payload_id").orderBy("position")
    return tours.where(F.col(state) == finished).withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= limit
    ).drop("_n")
