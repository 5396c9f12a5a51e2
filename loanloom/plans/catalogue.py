"""Importing this module registers every query of the catalogue."""

from loanloom.plans import (  # noqa: F401
    application_queries,
    evaluation_queries,
    extended_queries,
    history_queries,
    ledger_queries,
    planner_queries,
    profiling_queries,
    repayment_queries,
    scoring_queries,
    training_queries,
)
from loanloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
