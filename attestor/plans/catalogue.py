"""All queries of the engine, and the SQL that says what they return."""

from attestor.functions.workers import prepare
from attestor.plans import derived_queries, mini_corpus, synthetic_queries, text_queries

MODULES = [synthetic_queries, text_queries, derived_queries, mini_corpus]


def _with_workers(query):
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict:
    return {name: _with_workers(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
