"""All registered queries and their SQL."""

from __future__ import annotations

import functools

from clickloom.registry import batch_queries, batch_sql, live_queries, live_sql, model_queries, model_sql
from clickloom.session import configure


def _configured(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(configure(spark), sf_dir)

    return run


def queries():
    found = {**batch_queries.Q, **model_queries.Q, **live_queries.Q}
    return {name: _configured(fn) for name, fn in found.items()}


def oracle_sql():
    return {**batch_sql.SQL, **model_sql.SQL, **live_sql.SQL}
