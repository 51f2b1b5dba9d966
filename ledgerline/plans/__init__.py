"""Registered queries: each a plan over a folder of tables, most with SQL for an
oracle that computes the same rows another way."""

from ledgerline.plans import aggregates, artifacts, composites, joins, learning, reports, scalars, scans
from ledgerline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "composites", "joins", "learning", "reports", "scalars", "scans"]
