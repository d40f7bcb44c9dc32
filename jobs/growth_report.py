"""Yearly release of income-growth statistics: python -m jobs.growth_report SOURCE TARGET [--config FILE] [--years 1998 1999]

Reads SOURCE/orders.parquet as income records, builds the yearly panel and writes, for every base year, the statistics of log and arc
changes and of coming averages by age group and recent income (with totals) to TARGET, partitioned by base year. Each run replaces
the base years that it computes and no others, so a rerun leaves the same rows and a new year can be added alone; --years chooses
among the configured ones. A year without rows keeps no old partition of a shorter run: it is computed as empty and left as it is.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.panel import annual_panel
from cohortlake.plans.growth import growth_statistics

CONFIG = Path(__file__).with_suffix(".json")
log = logging.getLogger("jobs.growth_report")


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def income_panel(orders: DataFrame, config: Mapping) -> DataFrame:
    """id, yr, y, yob; birth years are given to customers in turn."""
    yob = F.lit(config["birth_year_from"]) + F.pmod(F.col("id"), F.lit(config["birth_years"]))
    return annual_panel(orders.filter("o_custkey is not null and o_orderdate is not null")).withColumn("yob", yob.cast("long"))


def run(spark: SparkSession, source: str, target: str, config: Mapping, years: Sequence[int] | None = None) -> DataFrame:
    """The whole report as it stands in target after this run."""
    chosen = [t for t in config["base_years"] if years is None or t in years]
    orders = spark.read.parquet(f"{source.rstrip('/')}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    log.info("read %d orders from %s", orders.count(), source)
    panel = income_panel(orders, config)
    report = growth_statistics(panel, range(config["first_year"], config["last_year"] + 1), chosen, config["floor"], config["least_years"], config["horizons"], config["coming_years"], config["groups"], config["percentiles"])
    # few rows: one file a year
    report.repartition(len(chosen) or 1, "base").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base").parquet(target)
    written = spark.read.schema(report.schema).parquet(target).select(*report.columns)
    for r in written.groupBy("base").count().orderBy("base").collect():  # one row a base year
        log.info("%s base year %s: %d rows in %s", "wrote" if r["base"] in chosen else "kept", r["base"], r["count"], target)
    return written


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--years", type=int, nargs="*")
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("growth_report").getOrCreate()
    try:
        run(spark, a.source, a.target, settings(a.config), a.years)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
