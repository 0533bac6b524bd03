"""All registered queries (importing the modules registers them)."""

from . import decision_queries, extra_queries, fidelity_queries, layout_queries, mask_queries, page_queries, pair_queries, protocol_queries, signal_queries, trace_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
