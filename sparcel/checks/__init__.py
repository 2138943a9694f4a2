"""The registered queries and their SQL equivalents, one module per area."""

from sparcel.checks import content, delivery, plans, profiles, records, registry, scalars, streams  # noqa: F401
from sparcel.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
