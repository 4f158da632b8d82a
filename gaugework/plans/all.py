"""Importing this module registers every query."""

from gaugework.plans import choices, projections, streams, summaries  # noqa: F401
from gaugework.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
