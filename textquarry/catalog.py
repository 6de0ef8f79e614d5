"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .queries import incremental, indexes, plans, ranking, statutes, texts, usage

MODULES = (texts, ranking, indexes, usage, incremental, statutes, plans)


def flagship(spark, sf_dir):
    return queries()["hybrid_search"](spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
