"""All registered queries."""

from vouchsafe.plans import (  # noqa: F401
    gate_queries,
    ledger_queries,
    sketch_queries,
    validation_queries,
    vector_queries,
)
from vouchsafe.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
