"""All queries of the core and their SQL."""

from __future__ import annotations

from shutterlake.plans import catalog_queries, data_queries, library_queries, more_queries, problems, problems_sql, stream_queries


def flagship(spark, root):
    return catalog_queries.browse_page(spark, root)


def queries():
    return problems.QUERIES | catalog_queries.query.queries | data_queries.query.queries | more_queries.query.queries | library_queries.query.queries | stream_queries.query.queries


def oracle_sql():
    return problems_sql.SQL | catalog_queries.query.sql | data_queries.query.sql | more_queries.query.sql | library_queries.query.sql | stream_queries.query.sql
