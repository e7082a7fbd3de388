"""Selection notation, market settlement and payout as column expressions.

An input that the rules do not cover gives a null outcome and a reason, so one
bad contract never fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Selection notations, Latin and Cyrillic.
TOTAL_PATTERN = r"(?i)^(TB|TM|ТБ|ТМ)\(?([0-9]+(?:[.,][0-9]+)?)\)?$"
HANDICAP_PATTERN = r"(?i)^[FФ]([12])\(([+-]?[0-9]+(?:[.,][0-9]+)?)\)$"
OVER_KINDS = ("TB", "ТБ")
RESULT_NOTATION = {"P1": "P1", "П1": "P1", "P2": "P2", "П2": "P2", "X": "X", "Х": "X"}


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.

    Rules that mention a parsed text a dozen times would otherwise repeat its
    parsing in the plan, and a filter on their result repeats it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact(selection: Column) -> Column:
    """Upper-cased text without blanks, the form all notations are compared in."""
    return F.replace(F.upper(F.trim(selection)), F.lit(" "), F.lit(""))


def _decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(10,3)")


def _group(text: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found)


def canonical_selection(selection: Column, market: Column, line: Column) -> Column:
    """Storage notation of a selection; null when it cannot be read.

    Totals accept over/under or the older text with an embedded line, which
    must then agree with the line column.
    """
    number = line.cast("decimal(10,3)")

    def total(text: Column) -> Column:
        kind = _group(text, TOTAL_PATTERN, 1)
        embedded = _decimal(_group(text, TOTAL_PATTERN, 2))
        agrees = number.isNull() | (embedded == number)
        read = F.when(kind.isin(*OVER_KINDS), "over").when(kind.isNotNull(), "under")
        return F.when(text.isin("OVER", "UNDER"), F.lower(text)).when(agrees, read)

    def result(text: Column) -> Column:
        chain = None
        for notation, canonical in RESULT_NOTATION.items():
            test = text == notation
            chain = F.when(test, canonical) if chain is None else chain.when(test, canonical)
        return chain

    code = F.lower(F.trim(market))
    text = compact(selection)
    return (
        F.when(code == "total", _bind(text, total))
        .when(code == "1x2", _bind(text, result))
        .otherwise(F.trim(selection))
    )


def _versus(left: Column, right: Column) -> Column:
    return F.when(left == right, "return").when(left > right, "win").otherwise("loss")


def _won(condition: Column) -> Column:
    return F.when(condition, "win").otherwise("loss")


def _half_step(line: Column) -> Column:
    doubled = line * F.lit(2)
    return doubled == F.floor(doubled)


def canonical_outcome(
    selection: Column, market: Column, line: Column, score1: Column, score2: Column
) -> Column:
    """Outcome of a contract whose selection is canonical; null when unsupported.

    A draw loses both side bets. Handicaps settle on whole and half lines only.
    """
    number = line.cast("decimal(10,3)")
    s1, s2 = score1.cast("decimal(10,3)"), score2.cast("decimal(10,3)")
    goals = s1 + s2
    code = F.lower(F.trim(market))

    def rules(chosen: Column) -> Column:
        total = F.when(chosen == "over", _versus(goals, number)).when(
            chosen == "under", _versus(number, goals)
        )
        result = (
            F.when(chosen == "p1", _won(s1 > s2))
            .when(chosen == "p2", _won(s2 > s1))
            .when(chosen == "x", _won(s1 == s2))
        )
        first = chosen.contains("f1") | chosen.startswith("1")
        second = chosen.contains("f2") | chosen.startswith("2")
        handicap = F.when(first, _versus(s1 + number, s2)).when(second, _versus(s2 + number, s1))
        return (
            F.when((code == "total") & number.isNotNull(), total)
            .when(code == "1x2", result)
            .when((code == "handicap") & number.isNotNull() & _half_step(number), handicap)
        )

    return F.when((score1 >= 0) & (score2 >= 0), _bind(F.lower(selection), rules))


def notation_outcome(selection: Column, score1: Column, score2: Column) -> Column:
    """Outcome of a contract given by its text alone, double chance included."""
    s1, s2 = score1.cast("decimal(10,3)"), score2.cast("decimal(10,3)")

    def rules(text: Column) -> Column:
        side = _group(text, HANDICAP_PATTERN, 1)
        spread = _decimal(_group(text, HANDICAP_PATTERN, 2))
        kind = _group(text, TOTAL_PATTERN, 1)
        number = _decimal(_group(text, TOTAL_PATTERN, 2))
        handicap = F.when(side == "1", _versus(s1 + spread, s2)).otherwise(_versus(s2 + spread, s1))
        total = F.when(kind.isin(*OVER_KINDS), _versus(s1 + s2, number)).otherwise(
            _versus(number, s1 + s2)
        )
        return (
            F.when(text.isin("P1", "П1"), _won(s1 > s2))
            .when(text.isin("P2", "П2"), _won(s2 > s1))
            .when(text.isin("X", "Х"), _won(s1 == s2))
            .when(text.isin("1X", "1Х"), _won(s1 >= s2))
            .when(text.isin("X2", "Х2"), _won(s2 >= s1))
            .when(text == "12", _won(s1 != s2))
            .when(side.isNotNull() & _half_step(spread), handicap)
            .when(kind.isNotNull(), total)
        )

    return F.when((score1 >= 0) & (score2 >= 0), _bind(compact(selection), rules))


def settlement_problem(
    outcome: Column, market: Column, line: Column, score1: Column, score2: Column
) -> Column:
    """Why a structured contract has no outcome; null when it has one."""
    code = F.lower(F.trim(market))
    number = line.cast("decimal(10,3)")
    return F.when(
        outcome.isNull(),
        F.when((score1 < 0) | (score2 < 0), "negative_score")
        .when(score1.isNull() | score2.isNull(), "missing_score")
        .when(~code.isin("1x2", "total", "handicap"), "unsupported_market")
        .when(code.isin("total", "handicap") & number.isNull(), "missing_line")
        .when((code == "handicap") & ~_half_step(number), "quarter_line")
        .otherwise("unsupported_selection"),
    )


def payout(outcome: Column, stake: Column, odds: Column) -> Column:
    return (
        F.when(outcome == "win", stake * odds)
        .when(outcome.isin("return", "void"), stake)
        .when(outcome == "loss", stake * F.lit(0))
    )


def unit_profit(outcome: Column, odds: Column) -> Column:
    """Profit of a one-unit stake, exact on the odds scale."""
    price = odds.cast("decimal(12,5)")
    unit = F.lit(1).cast("decimal(12,5)")
    return (
        F.when(outcome == "win", price - unit)
        .when(outcome == "loss", -unit)
        .when(outcome.isin("return", "void"), unit - unit)
        .cast("decimal(13,5)")
    )


def orient(first: Column, second: Column, reversed_sides: Column) -> tuple[Column, Column]:
    swap = F.coalesce(reversed_sides, F.lit(False))
    return F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)


def reversed_flag(frozen: Column, recorded: Column) -> Column:
    """Orientation frozen on the prediction, else the one recorded on the match."""
    return F.coalesce(frozen, recorded, F.lit(False))


def canonicalize(df: DataFrame) -> DataFrame:
    """Replace ``selection`` by its canonical form, keeping the source text."""
    canonical = canonical_selection(F.col("selection"), F.col("market"), F.col("line"))
    return df.withColumn("raw_selection", F.col("selection")).withColumn("selection", canonical)


def with_outcome(df: DataFrame) -> DataFrame:
    """Add ``outcome`` from selection, market, line, score1 and score2.

    The notation is read once, in a projection of its own: every branch of the
    settlement rules then refers to a plain column.
    """
    market, line = F.col("market"), F.col("line")
    read = df.withColumn("_side", canonical_selection(F.col("selection"), market, line))
    outcome = canonical_outcome(F.col("_side"), market, line, F.col("score1"), F.col("score2"))
    return read.withColumn("outcome", outcome).drop("_side")


def settle(df: DataFrame) -> DataFrame:
    """Add ``outcome`` and ``error_reason``."""
    names = ("outcome", "market", "line", "score1", "score2")
    return with_outcome(df).withColumn(
        "error_reason", settlement_problem(*[F.col(name) for name in names])
    )


def with_payout(df: DataFrame) -> DataFrame:
    staged = df.withColumn("payout", payout(F.col("outcome"), F.col("stake"), F.col("odds")))
    return staged.withColumn("profit", F.col("payout") - F.col("stake"))
