"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siftloom.plans import counting, membership, multi, sequences

MODULES = (membership, sequences, counting, multi)


def queries() -> dict:
    return {f.__name__.rstrip("_"): f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for module in MODULES for k, v in module.ORACLES.items()}
