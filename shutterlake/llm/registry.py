"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from shutterlake.llm import queries as q
from shutterlake.llm.queries_sql import SQL


def queries():
    return dict(q.QUERIES)


def oracle_sql():
    return dict(SQL)
