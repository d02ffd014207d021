"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from factloom.plans import problems, q_eval, q_facts, q_records, q_temporal, q_text, q_upkeep

MODULES = [problems, q_facts, q_temporal, q_text, q_eval, q_upkeep, q_records]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
