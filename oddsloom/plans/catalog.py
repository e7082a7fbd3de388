"""Importing this module registers every query."""

from oddsloom.plans import (
    audit,
    betting,
    corridor,
    form,
    ingest,
    learned,
    linkage,
    pricing,
    probability,
    records,
    signals,
    streams,
)  # noqa: F401
from oddsloom.plans.registry import ORACLES, QUERIES  # noqa: F401
