"""Prices, value, staking and bucket arithmetic as column expressions.

Odds stay ``decimal(12,5)`` where sums must not depend on the partitioning;
quantities derived from a model probability are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Staking formula and live stake limits.
OBSERVED_SLOPE = 10.0
OBSERVED_CAP = 3.0
DEFAULT_STAKE_PERCENT = 1.5
MIN_STAKE_PERCENT = 0.25
MAX_STAKE_PERCENT = 3.0
DEFAULT_BANKROLL = 100000.0


def fair_odds(probability: Column) -> Column:
    """1/p for p in (0, 1], otherwise null."""
    return F.when((probability > 0) & (probability <= 1), 1.0 / probability)


def value_ratio(probability: Column, odds: Column) -> Column:
    return odds.cast("double") * probability


def value_percent(probability: Column, odds: Column) -> Column:
    return (value_ratio(probability, odds) - 1.0) * 100.0


def minimum_odds(probability: Column, safety: Column) -> Column:
    return fair_odds(probability) * safety


def kelly_fraction(probability: Column, odds: Column) -> Column:
    b = odds.cast("double") - 1.0
    return F.when(b > 0, F.greatest(F.lit(0.0), (b * probability - (1.0 - probability)) / b))


def observed_multiplier(
    ratio: Column, slope: float = OBSERVED_SLOPE, cap: float = OBSERVED_CAP
) -> Column:
    return F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), (ratio - 1.0) * float(slope)))


def kelly_share(mode: Column) -> Column:
    """Fraction of Kelly a stake mode uses; null for modes that ignore the bankroll."""
    return F.when(mode == "kelly_0_1", F.lit(0.1)).when(mode == "kelly_0_25", F.lit(0.25))


def unit_stake(mode: Column, base_stake: Column, ratio: Column) -> Column:
    """Stake of the modes that do not look at the bankroll."""
    return F.when(mode == "fixed", base_stake).when(
        mode == "observed_ml", base_stake * observed_multiplier(ratio)
    )


def kelly_stake(
    bankroll: Column, probability: Column, odds: Column, share: Column, max_stake: Column
) -> Column:
    """Fractional Kelly of the given bankroll; a null ``max_stake`` means no limit."""
    return F.least(bankroll * share * kelly_fraction(probability, odds), max_stake)


def live_stake_percent(
    multiplier: Column,
    default: float = DEFAULT_STAKE_PERCENT,
    low: float = MIN_STAKE_PERCENT,
    high: float = MAX_STAKE_PERCENT,
) -> Column:
    """Clamped share of the bankroll, rounded half-even to two places."""
    raw = F.lit(default) * F.coalesce(multiplier, F.lit(1.0))
    clamped = F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    return F.bround(clamped.cast("decimal(18,10)"), 2).cast("decimal(5,2)")


def live_stake_amount(percent: Column, bankroll: float = DEFAULT_BANKROLL) -> Column:
    amount = F.lit(bankroll).cast("decimal(14,2)") * percent / F.lit(100)
    return F.bround(amount, 2).cast("decimal(14,2)")


def implied(odds: Column) -> Column:
    """Raw implied probability as a fixed-scale decimal, so sums are exact."""
    one = F.lit(1).cast("decimal(1,0)")
    return (one / odds.cast("decimal(12,5)")).cast("decimal(14,13)")


def bucket_index(odds: Column, width: str = "0.25") -> Column:
    """Index k of the half-open bucket [1+k*width, 1+(k+1)*width)."""
    above = odds.cast("decimal(12,5)") - F.lit("1").cast("decimal(1,0)")
    return F.floor(above / F.lit(width).cast("decimal(8,4)")).cast("long")


def bucket_low(index: Column, width: str = "0.25") -> Column:
    step = F.lit(width).cast("decimal(8,4)")
    return (F.lit(1).cast("decimal(1,0)") + index.cast("decimal(10,0)") * step).cast("decimal(12,4)")


def bucket_high(index: Column, width: str = "0.25") -> Column:
    return (bucket_low(index, width) + F.lit(width).cast("decimal(8,4)")).cast("decimal(12,4)")


def corridor_confidence(wins: Column, samples: Column) -> Column:
    """Bounded reliability: sample depth times one minus the interval width."""
    rate = wins / samples
    error = F.sqrt(F.greatest(F.lit(0.0), rate * (1.0 - rate) / samples))
    certainty = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), 3.92 * error))
    depth = F.least(F.lit(1.0), samples / 100.0)
    return F.bround((depth * certainty).cast("decimal(18,12)"), 4).cast("double")


def corridor_verdict(samples: Column, roi: Column, edge: Column, minimum: int = 20) -> Column:
    return (
        F.when(samples < minimum, "insufficient")
        .when((roi > 0) & (edge > 0), "confirm")
        .when((roi < 0) & (edge < 0), "conflict")
        .otherwise("neutral")
    )


def line_text(line: Column) -> Column:
    """Line without trailing zeros, ``-`` when there is none."""
    text = line.cast("decimal(10,3)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(trimmed, F.lit("-"))


def alert_key(
    strategy: Column, event: Column, market: Column, selection: Column, line: Column
) -> Column:
    return F.concat_ws(":", strategy, event.cast("string"), market, selection, line_text(line))


def delivery_expiry(event_start: Column, quote_at: Column, stale_seconds: Column) -> Column:
    stale_at = F.timestamp_micros(
        F.unix_micros(quote_at) + (stale_seconds * 1000000).cast("long")
    )
    return F.least(event_start, stale_at)


def freshness(status: Column, age_seconds: Column, fresh_for: Column) -> Column:
    """Health of a source from its latest run: ok, warn or error."""
    return (
        F.when((status == "success") & (age_seconds <= fresh_for), "ok")
        .when(status.isin("success", "partial"), "warn")
        .otherwise("error")
    )
