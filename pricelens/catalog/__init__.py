"""Registered queries over the driver tables, each with its check in SQL."""

from pricelens.catalog.registry import ORACLES, QUERIES
from pricelens.catalog import (  # noqa: F401  (importing registers the queries)
    q_deals, q_history, q_legacy, q_market, q_match, q_parse, q_report, q_sources,
)

__all__ = ["ORACLES", "QUERIES"]
