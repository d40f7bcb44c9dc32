"""Registration, and the inputs that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.panel import annual_panel, with_age
from cohortlake.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Income floor of the samples drawn from the customer panel.
FLOOR = 50000.0

PANEL_SQL = "p as (select o_custkey as id, cast(year(o_orderdate) as bigint) as yr, round(sum(o_totalprice), 2) as y from orders group by 1, 2)"
AGED_SQL = PANEL_SQL + ", g as (select id, yr, y, 1940 + id % 36 as yob, yr - (1940 + id % 36) + 1 as age from p)"


def query(sql: str | None = None, base: str = ""):
    """Register a function under its name. base: panel or aged, a common table expression put before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = {"": "", "panel": PANEL_SQL, "aged": AGED_SQL}[base]
            body = sql.strip()
            if head:
                body = f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}"
            SQL[f.__name__] = body
        return f

    return add


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_panel(table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]))


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_age(panel(spark, sf_dir), 1940 + F.col("id") % 36)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, since sums depend on the order of addition in their last digits."""
    return df.select(*[F.round(F.col(c), own.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
