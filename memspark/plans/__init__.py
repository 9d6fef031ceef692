"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from memspark.fixtures import with_views
from memspark.plans.oracles import SQL
from memspark.plans.oracles_loop import LOOP_SQL


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each registered query, by its name."""
    return {name: with_views(sql) for name, sql in (SQL | LOOP_SQL).items()}
