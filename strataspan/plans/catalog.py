"""All queries of the engine proper. Importing the modules registers them."""

from __future__ import annotations

from strataspan.plans import image_queries, interval_queries, record_queries  # noqa: F401
from strataspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
