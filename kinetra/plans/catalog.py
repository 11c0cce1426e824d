"""All queries over the driver's tables."""

from kinetra.plans import coverage, motion, navigation, relational, sequential, streams  # noqa: F401
from kinetra.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
