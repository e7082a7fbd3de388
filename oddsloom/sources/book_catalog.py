"""Bookmaker catalog: nested sports, events and factors to flat tables.

Input rows are payloads with ``payload_id``, ``received_at`` and ``body``
(text). Every output row carries the payload it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom import schemas
from oddsloom.functions import clock
from oddsloom.functions import text as text_fn

# Tournament markers, source families, country marks, factor ids.
TARGET_MARKERS = ("esportsbattle", "h2h", "united esports leagues")
FAMILIES = (
    ("esportsbattle", "esb"),
    ("united esports leagues", "uel"),
    ("h2h gg league", "h2h_ggl"),
    ("h2h", "h2h"),
)
COUNTRIES = (("чехия", "CZ"), ("czech", "CZ"))
SPORTS = {"football": "ef", "hockey": "eh"}
GAME = r"(?i)\b(FC|NHL)\s*([0-9]{2})\b"
FORMAT = r"(?i)([0-9]+)\s*[xх×]\s*([0-9]+)"
RESULT_FACTORS = {921: "P1", 922: "X", 923: "P2"}
HANDICAP_FACTORS = {927: "F1", 928: "F2"}
TOTAL_FACTORS = {930: "over", 931: "under"}
MARKET_NAMES = {
    "1x2": "Full time result", "handicap": "Full time handicap", "total": "Full time total",
}


def _first_marker(name: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    folded = F.lower(name)
    chain = None
    for mark, value in marks:
        test = folded.contains(mark)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def source_family(name: Column) -> Column:
    return _first_marker(name, FAMILIES)


def country(name: Column) -> Column:
    return _first_marker(name, COUNTRIES)


def game(name: Column) -> Column:
    """Game with its version, such as FC26; null without one."""
    return F.when(
        name.rlike(GAME),
        F.concat(F.upper(F.regexp_extract(name, GAME, 1)), F.regexp_extract(name, GAME, 2)),
    )


def match_format(name: Column) -> Column:
    """Periods and minutes, such as 2x4; the separator may be Latin, Cyrillic or a sign."""
    return F.when(
        name.rlike(FORMAT),
        F.concat(F.regexp_extract(name, FORMAT, 1), F.lit("x"), F.regexp_extract(name, FORMAT, 2)),
    )


def line(line_text: Column, hundredths: Column) -> Column:
    """Decimal text first, else an integer in hundredths; bad text gives null."""
    return F.when(line_text.isNotNull(), F.trim(line_text).try_cast("decimal(10,3)")).otherwise(
        (hundredths.cast("decimal(18,0)") / F.lit(100)).cast("decimal(10,3)")
    )


def _plain(number: Column, original: Column) -> Column:
    """Line as written in the payload, else without trailing zeros."""
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.trim(original), shown)


def factor_identity(factor: Column, number: Column, original: Column) -> Column:
    """struct(market, market_name, selection) of a factor id.

    Totals carry the line in its own column, handicaps in the selection text;
    parameterized factors without a line stay unmapped.
    """
    def identity(market: str, selection: Column | str) -> Column:
        chosen = F.lit(selection) if isinstance(selection, str) else selection
        return F.struct(
            F.lit(market).alias("market"), F.lit(MARKET_NAMES[market]).alias("market_name"),
            chosen.alias("selection"),
        )

    text = factor.cast("string")
    unmapped = F.struct(
        F.lit("unmapped_factor").alias("market"),
        F.concat(F.lit("Unmapped factor "), text).alias("market_name"),
        F.concat(F.lit("factor:"), text).alias("selection"),
    )
    chain = F.when(F.lit(False), unmapped)
    for number_id, selection in RESULT_FACTORS.items():
        chain = chain.when(factor == number_id, identity("1x2", selection))
    for number_id, side in HANDICAP_FACTORS.items():
        shown = F.concat(F.lit(f"{side}("), _plain(number, original), F.lit(")"))
        chain = chain.when((factor == number_id) & number.isNotNull(), identity("handicap", shown))
    for number_id, selection in TOTAL_FACTORS.items():
        chain = chain.when((factor == number_id) & number.isNotNull(), identity("total", selection))
    return chain.otherwise(unmapped)


def _target_nodes(tree: Column) -> Column:
    """Nodes of a sport tree that are target tournaments of a known sport and family."""
    def wanted(node: Column) -> Column:
        marked = F.lit(False)
        for mark in TARGET_MARKERS:
            marked = marked | F.lower(node["name"]).contains(mark)
        return node["id"].isNotNull() & F.coalesce(marked, F.lit(False))

    def usable(node: Column) -> Column:
        return wanted(node) & _root_alias(tree, node).isin(*SPORTS) & source_family(node["name"]).isNotNull()

    return F.filter(tree, usable)


def _root_alias(tree: Column, node: Column) -> Column:
    parents = F.filter(tree, lambda other: other["id"] == node["parentId"])
    return F.try_element_at(parents, F.lit(-1))["alias"]


def _targets(tree: Column) -> Column:
    """Target tournaments of a sport tree, from the array itself."""
    def shaped(node: Column) -> Column:
        name = node["name"]
        return F.struct(
            node["id"].alias("id"), name.alias("name"),
            _root_alias(tree, node).alias("sport"), game(name).alias("game"),
            match_format(name).alias("format"), source_family(name).alias("family"),
            country(name).alias("country"),
        )

    return F.transform(_target_nodes(tree), shaped)


def _invalid_core(event: Column) -> Column:
    return event["id"].isNull() | event["team1"].isNull() | event["team2"].isNull()


def decode(payloads: DataFrame) -> DataFrame:
    """payload_id, received_at and ``j``, the parsed body; null where it is no JSON object of the known shape."""
    return payloads.select(
        "payload_id", "received_at", F.from_json("body", schemas.BOOK_CATALOG).alias("j")
    )


def parse(payloads: DataFrame) -> dict[str, DataFrame]:
    """:func:`tables` of payloads that are decoded where each table is computed."""
    return tables(decode(payloads))


def tables(read: DataFrame) -> dict[str, DataFrame]:
    """tournaments, events, quotes, rejects, items (root events of known tournaments), received and outcomes.

    ``outcomes`` holds the received number and the items of each payload in one
    row; rejects, items and received are read off it.

    ``received`` counts all events of a payload, looked at or not; 0 where it
    cannot be read.

    A payload is self-contained: parents, tournaments and events are looked up
    in its own arrays. Payloads are parsed independently, without a shuffle.
    """
    # No filter on the parsed column: it would be pushed below the projection and
    # parse every payload again. Explode alone implies one (a size above zero), so
    # arrays are exploded with their empty ones, whose rows are dropped after it.
    broken = F.col("j.sports").isNull() | F.col("j.events").isNull()
    # Ids are looked up for each event, so they come without the other columns of a target.
    ids = F.transform(_target_nodes(F.col("j.sports")), lambda node: node["id"])
    roots = F.filter("j.events", lambda e: (e["level"] == 1) & F.array_contains(ids, e["sportId"]))
    held = read.select(
        "payload_id", "received_at", _targets(F.col("j.sports")).alias("targets"),
        F.col("j.customFactors").alias("groups"), roots.alias("roots"),
    )

    tournaments = held.select("payload_id", "received_at", F.explode_outer("targets").alias("t")).where(
        F.col("t").isNotNull()
    ).select(
        "payload_id", "received_at", F.col("t.id").cast("string").alias("tournament_id"),
        "t.name", "t.sport", "t.game", "t.format", "t.family", "t.country",
    )

    def reason(e: Column) -> Column:
        identifier = F.coalesce(e["id"].cast("string"), F.lit("<missing>"))
        return F.when(
            _invalid_core(e), F.concat(F.lit("invalid core fields for event "), identifier)
        ).when(e["startTime"].isNull(), F.concat(F.lit("missing startTime for event "), identifier))

    seen = held.select(
        "payload_id", "received_at", "targets", F.posexplode_outer("roots").alias("position", "e")
    ).where(F.col("position").isNotNull())
    owner = F.try_element_at(F.filter("targets", lambda t: t["id"] == F.col("e.sportId")), F.lit(-1))
    items = seen.withColumns({"reject_reason": reason(F.col("e")), "t": owner}).drop("targets")
    team1, player1 = text_fn.split_participant(F.col("e.team1"))
    team2, player2 = text_fn.split_participant(F.col("e.team2"))
    short = F.when(F.col("t.sport") == "football", SPORTS["football"]).otherwise(SPORTS["hockey"])
    events = items.where(F.col("reject_reason").isNull()).select(
        "payload_id", "received_at", F.col("e.id").cast("string").alias("event_id"),
        F.concat_ws("_", "t.family", short, F.col("e.id").cast("string")).alias("internal_id"),
        F.col("t.id").cast("string").alias("tournament_id"), "t.sport", "t.game", "t.format",
        clock.from_epoch_seconds(F.col("e.startTime")).alias("started_at"),
        F.when(F.col("e.place") == "live", "live").when(F.col("e.place") == "line", "scheduled")
        .otherwise("unknown").alias("status"),
        F.col("e.team1").alias("raw_name1"), team1.alias("team_name1"), player1.alias("player_name1"),
        F.col("e.team2").alias("raw_name2"), team2.alias("team_name2"), player2.alias("player_name2"),
    )

    valid = F.filter("roots", lambda e: ~_invalid_core(e) & e["startTime"].isNotNull())
    priced = held.select(
        "payload_id", "received_at", "groups", F.transform(valid, lambda e: e["id"]).alias("event_ids")
    )
    kept = F.filter("groups", lambda g: F.array_contains(F.col("event_ids"), g["e"]))
    factors = (
        priced.select("payload_id", "received_at", F.explode_outer(kept).alias("g"))
        .where(F.col("g").isNotNull())
        .select("payload_id", "received_at", F.col("g.e").cast("string").alias("event_id"), F.explode_outer("g.factors").alias("f"))
        .where(F.col("f.f").isNotNull() & (F.col("f.v") > 1))
        .withColumn("line", line(F.col("f.pt"), F.col("f.p")))
    )
    quotes = factors.select(
        "payload_id", "received_at", "event_id", F.col("f.f").cast("string").alias("factor_id"),
        factor_identity(F.col("f.f"), F.col("line"), F.col("f.pt")).alias("i"),
        F.col("f.v").cast("decimal(12,5)").alias("odds"), "line",
    ).select("payload_id", "received_at", "event_id", "factor_id", "i.*", "odds", "line")

    judged = F.transform(
        roots, lambda e, position: F.struct(position.alias("position"), reason(e).alias("reject_reason"))
    )
    failed = F.struct(F.lit(-1).alias("position"), F.lit("payload requires sports and events arrays").alias("reject_reason"))
    outcomes = read.select(
        "payload_id", "received_at", F.greatest(F.coalesce(F.size("j.events"), F.lit(0)), F.lit(0)).alias("received"),
        F.when(broken, F.array(failed)).otherwise(judged).alias("outcomes"),
    )
    return {
        "tournaments": tournaments,
        "events": events,
        "quotes": quotes,
        "outcomes": outcomes,
        **outcome_tables(outcomes),
    }


def outcome_tables(outcomes: DataFrame) -> dict[str, DataFrame]:
    """rejects, items and received of :func:`tables` from its ``outcomes``, which a caller may have written."""
    listed = outcomes.select("payload_id", "received_at", F.explode_outer("outcomes").alias("o")).where(
        F.col("o").isNotNull()
    ).select("payload_id", "received_at", "o.position", "o.reject_reason")
    return {
        "rejects": listed.where(F.col("reject_reason").isNotNull()),
        "items": listed,
        "received": outcomes.select("payload_id", "received_at", "received"),
    }
