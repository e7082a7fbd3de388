"""Shapes of the source payloads, as DDL."""

from __future__ import annotations

NAMED = "token string, token_international string"

BOOK_CATALOG = """
packetVersion bigint,
sports array<struct<id: bigint, parentId: bigint, kind: string, name: string, alias: string>>,
events array<struct<id: bigint, parentId: bigint, level: bigint, sportId: bigint, team1: string,
  team2: string, name: string, startTime: bigint, place: string>>,
customFactors array<struct<e: bigint, countAll: bigint,
  factors: array<struct<f: bigint, v: double, p: bigint, pt: string>>>>
"""

HISTORY_A_PAGE = """
totalPages bigint,
tournaments array<struct<id: bigint, status_id: bigint, token: string, token_international: string>>
"""

HISTORY_A_TOURNAMENT = f"id bigint, status_id bigint, {NAMED}"

_PARTICIPANT_A = (
    "struct<id: bigint, nickname: string, score: bigint, "
    "team: struct<id: bigint, token: string, token_international: string>>"
)
HISTORY_A_MATCHES = (
    "array<struct<id: bigint, date: string, status_id: bigint, "
    f"participant1: {_PARTICIPANT_A}, participant2: {_PARTICIPANT_A}>>"
)

HISTORY_B_PAGE = """
items array<struct<id: string, id_sl: string, date_time: string, title_ru: string,
  title_en: string, country: string, state: string>>,
total_items string
"""

_SIDE_B = ", ".join(
    f"player{side}_id: string, team{side}_id: string, score_team{side}: string, "
    f"player_{side}_id_sl: string, player_{side}_title_en: string, player_{side}_title_ru: string, "
    f"team_{side}_id_sl: string, team_{side}_title_en: string, team_{side}_title_ru: string"
    for side in (1, 2)
)
HISTORY_B_GAMES = (
    "tour_blocks struct<games: array<struct<id: string, id_sl: string, date_time: string, "
    f"state: string, updated_at: string, {_SIDE_B}>>>"
)

HISTORY_C_SCHEDULE = """
array<struct<externalId: string, startDate: string, isCancelled: boolean, teamAName: string,
  teamBName: string, participantAName: string, participantBName: string, streamName: string,
  tournamentName: string, matchStatus: string, teamAScore: bigint, teamBScore: bigint>>
"""

# Raw payloads: one row per external response.
RAW_PAYLOAD = (
    "provider string, kind string, url string, status_code int, content_type string, "
    "headers map<string,string>, received_at timestamp, body binary"
)

OBSERVATION = """
array<struct<id: string, evidence_kind: string, timestamp: string, source: string, sport: string,
  event: string, market: string, odds: double, shown_value: double, v: double, mo: double,
  bet_mul: double, bet: double, strategy: string, un: string, provenance: string, notes: string>>
"""
