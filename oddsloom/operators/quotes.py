"""Latest and closing quotes, price movement and margin removal.

The newest quote of a contract is an aggregate (``max_by`` on received_at and
snapshot_id), not a sort: it combines on the map side, so a contract holding a
large share of all quotes stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.functions import odds as odds_fn
from oddsloom.functions import settlement

CONTRACT = ("contract_event", "market", "selection", "line")


def valid_contract(market: Column, selection: Column, line: Column) -> Column:
    """A 1x2 needs one of its three selections, a total a side and a line."""
    result = (market == "1x2") & selection.isin("P1", "X", "P2")
    total = (market == "total") & selection.isin("over", "under") & line.isNotNull()
    return F.coalesce(result | total, F.lit(False))


def canonical(quotes: DataFrame) -> DataFrame:
    """Canonical notation, unreadable or incomplete contracts left out."""
    read = settlement.canonicalize(quotes)
    return read.where(valid_contract(F.col("market"), F.col("selection"), F.col("line")))


def newest(quotes: DataFrame, keys: Sequence[str] = CONTRACT) -> DataFrame:
    """One row per contract: the last received quote, the larger id on a tie."""
    kept = F.struct(*[name for name in quotes.columns if name not in keys])
    order = F.struct("received_at", "snapshot_id")
    return quotes.groupBy(*keys).agg(F.max_by(kept, order).alias("q")).select(*keys, "q.*")


def closing_quotes(
    quotes: DataFrame, keys: Sequence[str] = CONTRACT, max_age_seconds: float | None = None
) -> DataFrame:
    """Last quote before kickoff; with a limit, only if it is recent enough.

    The age test follows the choice: an old last quote is dropped, it does not
    give way to another one.
    """
    chosen = newest(quotes.where(F.col("received_at") < F.col("kickoff")), keys)
    if max_age_seconds is None:
        return chosen
    age = F.unix_micros("kickoff") - F.unix_micros("received_at")
    return chosen.where(age <= int(max_age_seconds * 1_000_000))


def latest_quotes(quotes: DataFrame, now: Column, keys: Sequence[str] = CONTRACT) -> DataFrame:
    """Last quote received up to ``now`` per canonical contract."""
    return newest(canonical(quotes.where(F.col("received_at") <= now)), keys)


def odds_movement(
    quotes: DataFrame, keys: Sequence[str] = CONTRACT, cutoff: str = "kickoff"
) -> DataFrame:
    """Opening and current price before the cutoff, change and observation count."""
    order = F.struct("received_at", "snapshot_id")
    point = F.struct("odds", "received_at")
    seen = quotes.where((F.col("received_at") < F.col(cutoff)) & (F.col("odds") > 1))
    ends = seen.groupBy(*keys).agg(
        F.min_by(point, order).alias("first"),
        F.max_by(point, order).alias("last"),
        F.count("*").alias("observations"),
    )
    opening, current = F.col("first.odds").cast("double"), F.col("last.odds").cast("double")
    seconds = (F.unix_micros("last.received_at") - F.unix_micros("first.received_at")) / 1e6
    return ends.select(
        *keys,
        opening.alias("opening_odds"),
        current.alias("current_odds"),
        (current - opening).alias("change_absolute"),
        (100.0 * (current - opening) / opening).alias("change_percent"),
        seconds.alias("seconds_since_open"),
        "observations",
    )


def implied_probabilities(quotes: DataFrame, market_keys: Sequence[str]) -> DataFrame:
    """Raw and margin-free probability of each selection of a market.

    One quote per selection is expected; markets with a single selection have
    no margin to remove and are left out.
    """
    market = Window.partitionBy(*market_keys)
    priced = quotes.where(F.col("odds") > 1).withColumn("raw", odds_fn.implied(F.col("odds")))
    # A window, not a list: a market with very many rows spills instead of filling a row.
    markets = priced.withColumns(
        {"overround": F.sum("raw").over(market), "sides": F.count("*").over(market)}
    ).where("sides >= 2")
    return markets.select(
        *market_keys,
        "selection",
        "odds",
        F.col("raw").cast("double").alias("raw_probability"),
        (F.col("raw").cast("double") / F.col("overround").cast("double")).alias(
            "normalized_probability"
        ),
        F.col("overround").cast("double").alias("overround"),
    )
