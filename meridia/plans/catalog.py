"""All queries of the engine but those of the text operators, with SQL for those that SQL can express."""

from __future__ import annotations

from . import guiding, holdings, mending, movement, naming, network, outlines, relational

PARTS = (movement, holdings, network, mending, guiding, outlines, naming, relational)


def queries():
    return {name: q for part in PARTS for name, q in part.queries().items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
