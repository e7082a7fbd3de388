"""Name folding and similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters removed before folding, ASCII blanks, label shapes.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
ASCII_BLANKS = r"[\x09-\x0D\x1C-\x20]+"
TRAILING_PLAYER = r"\(([^()]*)\)\s*$"
PARTICIPANT = r"^\s*(.+?)\s*\(([^()]*)\)\s*$"

KINDS = ("text", "player", "team", "source")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_ascii(text: Column) -> Column:
    """Lower case, blanks collapsed and trimmed; exact for ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), ASCII_BLANKS, " "))


def fold(value: str, keep_zero_width: bool) -> str:
    folded = unicodedata.normalize("NFKC", value)
    if not keep_zero_width:
        folded = folded.translate(dict.fromkeys(map(ord, ZERO_WIDTH)))
    return " ".join(folded.casefold().split())


def _fold_udf(keep_zero_width: bool):
    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda value: fold(value, keep_zero_width), na_action="ignore")

    return folded


def unwrap_player(label: Column) -> Column:
    """The nickname in a trailing ``Team (nickname)``, else the whole label."""
    nickname = F.regexp_extract(label, TRAILING_PLAYER, 1)
    return F.when(F.trim(nickname) != "", nickname).otherwise(label)


def split_participant(label: Column) -> tuple[Column, Column]:
    """(team, player) of ``Team (player)``; nulls for any other shape."""
    shaped = label.rlike(PARTICIPANT)
    team = F.when(shaped, F.trim(F.regexp_extract(label, PARTICIPANT, 1)))
    return team, F.when(shaped, F.trim(F.regexp_extract(label, PARTICIPANT, 2)))


def first_text(*options: Column) -> Column:
    """First option that is not blank, trimmed."""
    trimmed = [F.trim(option) for option in options]
    return F.coalesce(*[F.when(text != "", text) for text in trimmed])


def normalize_names(df: DataFrame, column: str, kind: str = "text", output: str = "normalized") -> DataFrame:
    """Add the folded form of a name column.

    Unicode folding needs Python, but only names outside ASCII are folded
    there; everything else stays in generated code. A null name stays null.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    text = unwrap_player(F.col(column)) if kind == "player" else F.col(column)
    staged = df.withColumn("_raw", text).withColumn(
        "_plain", F.when(is_ascii(F.col("_raw")), fold_ascii(F.col("_raw")))
    )
    # Only names outside ASCII reach Python; the rest pass as nulls, and no row is moved.
    other = F.when(F.col("_plain").isNull(), F.col("_raw"))
    folded = F.coalesce("_plain", _fold_udf(kind == "source")(other))
    return staged.select(*df.columns, folded.alias(output))


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64"
    )


def sequence_ratio(left: Column, right: Column) -> Column:
    """Matching-block similarity; give it distinct pairs only."""
    return F.pandas_udf(_ratios, "double")(left, right)


def levenshtein_ratio(left: Column, right: Column) -> Column:
    """Edit similarity in generated code."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    return 1.0 - F.levenshtein(left, right) / F.greatest(longest, F.lit(1))


def tournament_key(sport: Column, folded_name: Column) -> Column:
    """Stable id of a tournament known by name only."""
    return F.concat_ws(":", sport, F.substring(F.sha2(folded_name, 256), 1, 16))
