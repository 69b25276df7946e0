"""Registered queries over the driver tables."""

from sievework.plans import browse, corpus, ingest, planning, statistics  # noqa: F401
from sievework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
