"""The registered queries of the panel operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from cohortlake.queries import basics, files, growth, jobs, models, panels, statistics
    from cohortlake.queries.registry import QUERIES

    assert basics and files and growth and jobs and models and panels and statistics
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from cohortlake.queries.registry import SQL

    queries()
    return dict(SQL)
