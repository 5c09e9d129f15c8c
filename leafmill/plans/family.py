"""Registration of a family of queries."""
from __future__ import annotations


def family():
    """Query and SQL tables of one family and the decorator that fills them.

    ``@query(name, sql)`` registers a function ``(spark, sf_dir) -> DataFrame`` with
    its SQL twin; without SQL only the rows are checked.
    """
    queries: dict = {}
    sql_twins: dict = {}

    def query(name, sql=None):
        def add(fn):
            queries[name] = fn
            if sql:
                sql_twins[name] = sql
            return fn

        return add

    return queries, sql_twins, query
