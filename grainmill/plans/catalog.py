"""All queries over the reference's operators, and their SQL."""

from __future__ import annotations

from grainmill.plans import dictionaries, evaluation, matching, relational, reports, streams, textual

MODULES = [relational, textual, evaluation, matching, reports, dictionaries, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
