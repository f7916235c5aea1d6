"""All queries of the engine itself."""

from __future__ import annotations

from netloom.plans import circuits, graphs, ordered, tables
from netloom.queries import ORACLES, QUERIES

PLANS = (tables, ordered, graphs, circuits)
FLAGSHIP = circuits.exhaustive_states


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
