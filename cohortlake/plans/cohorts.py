"""Cohort simulators as keyed column updates: start a base year, add a cohort's first year, project everyone by one year. Draws are normal
numbers from digests of (seed, person, year), so a year's result does not depend on the plan or on which other cohorts are there."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.scalar import logistic, uniform
from cohortlake.plans.simulation import PARAMETERS, derived

FIRST_AGE = 25


def normal(seed: str, *keys: Column) -> Column:
    """A standard normal number from keys, by the polar form of two uniform ones."""
    u = F.greatest(uniform(f"{seed}-radius", *keys), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(f"{seed}-angle", *keys))


def _parameters(theta: Mapping[str, float] | None) -> dict[str, float]:
    t = dict(theta or {k: v[0] for k, v in PARAMETERS.items()})
    return t | derived(t)


def _income(people: DataFrame, t: Mapping[str, float], seed: str) -> DataFrame:
    """income of everyone's current age from alpha, beta and z."""
    key = [F.col("id"), F.col("age")]
    s = (F.col("age") - FIRST_AGE + 1) / 10
    xi = t["nu_const"] + t["nu_age"] * s + t["nu_z"] * F.col("z") + t["nu_inter"] * s * F.col("z")
    idle = F.when(uniform(f"{seed}-idle", *key) <= logistic(xi), F.least(-F.ln(F.greatest(uniform(f"{seed}-share", *key), F.lit(1e-15))) / t["nu_lam"], F.lit(1.0))).otherwise(0.0)
    first = uniform(f"{seed}-eps", *key) <= t["pr_eps"]
    eps = F.when(first, t["mu_eps1"] + t["sd_eps1"] * normal(f"{seed}-e", *key)).otherwise(t["mu_eps2"] + t["sd_eps2"] * normal(f"{seed}-e", *key))
    level = t["a0"] + t["a1"] * s + t["a2"] * s * s + F.col("alpha") + F.col("beta") * s + F.col("z") + eps
    return people.withColumn("income", F.greatest(F.lit(0.0), (1 - idle) * F.exp(level)))


def _step(z: Column, t: Mapping[str, float], seed: str, age: Column | None = None) -> Column:
    key = [F.col("id"), F.col("age") if age is None else age]
    first = uniform(f"{seed}-p", *key) <= t["pdf_ar"]
    eta = normal(f"{seed}-eta", *key)
    return t["rho1"] * z + F.when(first, t["mu_eta1"] + t["sd_eta1"] * eta).otherwise(t["mu_eta2"] + t["sd_eta2"] * eta)


def first_year(people: DataFrame, theta: Mapping[str, float] | None = None, seed: str = "c") -> DataFrame:
    """People (id, cohort) at the first age: person effects, first z and income."""
    t = _parameters(theta)
    one, two = normal(f"{seed}-1", F.col("id")), normal(f"{seed}-2", F.col("id"))
    born = people.select("id", "cohort", F.lit(FIRST_AGE).alias("age"), (t["sigma_alpha"] * one).alias("alpha"), (t["on_first"] * one + t["on_second"] * two).alias("beta"))
    return _income(born.withColumn("z", _step(t["sd_z0"] * normal(f"{seed}-z0", F.col("id")), t, seed)), t, seed)


def projected(people: DataFrame, theta: Mapping[str, float] | None = None, seed: str = "c", last_age: int = 60) -> DataFrame:
    """Everyone one year older; those beyond the last age leave."""
    t = _parameters(theta)
    older = people.filter(F.col("age") < last_age).withColumn("age", F.col("age") + 1)
    return _income(older.withColumn("z", _step(F.col("z"), t, seed)), t, seed)


def base_year(spark: SparkSession, per_cohort: int, cohorts: range, year: int, theta: Mapping[str, float] | None = None, seed: str = "c") -> DataFrame:
    """Everyone of the cohorts aged 25 to 60 in a year. The years since the first are a fold inside each row."""
    n = len(cohorts)
    people = spark.range(per_cohort * n).select("id", (F.col("id") % n + cohorts.start).cast("int").alias("cohort"))
    start = first_year(people.filter(F.lit(year) - F.col("cohort") >= FIRST_AGE), theta, seed).filter(F.lit(year) - F.col("cohort") <= 60)
    t = _parameters(theta)
    age = F.lit(year) - F.col("cohort")
    later = F.filter(F.sequence(F.lit(FIRST_AGE), age), lambda a: a > FIRST_AGE)
    return _income(start.withColumn("z", F.aggregate(later, F.col("z"), lambda z, a: _step(z, t, seed, a))).withColumn("age", age), t, seed)
