"""All registered queries of the library outside ``llm`` and their comparison SQL."""

from __future__ import annotations

from quernstone.plans import round_trips
from quernstone.plans.queries import ORACLES, QUERIES

FLAGSHIP = "search_names"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "round_trips"]
