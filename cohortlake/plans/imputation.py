"""Imputation of self-employment income above the taxable maximum, from quantile regressions on three years of history.

In the fit year the log of self-employment income of persons at or above that year's maximum is regressed, by age group and at the middle
of each of `slots` quantile slots, on a constant and seventeen features: whether wages were below the floor and their log, in the year and the
three before it, and of the three years before whether self-employment income was capped, whether it was below the floor, and its log
up to the cap. In any other year the same features, shifted to it, meet the coefficients of the person's age group and slot, which is
drawn once for each person; the prediction is scaled by the year's maximum over the fit year's and counts where it is more than what was
observed. Features are expressions in one array of years per person and the coefficients one literal array, so nothing is shuffled.

Incomes that are missing in a year count as zero in features; a person's year without self-employment income has no row. Logs are zero
below the floor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.scalar import md5_uniform
from cohortlake.operators.quantile_regression import quantile_regressions
from cohortlake.plans.growth import BEGIN, RETIRE, at_base, five_year_bins

SLOTS = 75
LAGS = (3, 2, 1)
#: Coefficients that one literal array may hold.
MOST = 1 << 17


def names() -> list[str]:
    wages = [f"{f}_wage{k}" for f in ("zero", "ln") for k in (*LAGS, 0)]
    return wages + [f"{f}_self{k}" for f in ("capped", "zero", "ln") for k in LAGS]


def features(first: int, floors: Mapping[int, float], caps: Mapping[int, float]) -> list[Column]:
    """The seventeen features of the person in the year `base`, in the order of names()."""
    table = lambda x, k: F.get(F.lit([float(x[t]) for t in range(first, max(x) + 1)]), (F.col("base") - first - k).cast("int"))
    income = lambda v, k: F.coalesce(at_base(v, -k, first), F.lit(0.0))

    def zero(v: str, k: int) -> Column:
        return (income(v, k) < table(floors, k)).cast("double")

    def log(v: str, k: int) -> Column:
        return F.when(income(v, k) >= table(floors, k), F.ln(income(v, k))).otherwise(0.0)

    wages = [f("wage", k) for f in (zero, log) for k in (*LAGS, 0)]
    capped = [(income("selfinc", k) >= table(caps, k)).cast("double") for k in LAGS]
    return wages + capped + [zero("selfinc", k) for k in LAGS] + [F.least(log("selfinc", k), F.ln(table(caps, k))) for k in LAGS]


def person_years(persons: DataFrame, years: Sequence[int]) -> DataFrame:
    """persons (id, yob, wage, selfinc arrays) in each year that they are of working age, with their age group."""
    rows = persons.withColumn("base", F.explode(F.array(*map(F.lit, years)).cast("array<bigint>"))).withColumn("age", F.col("base") - F.col("yob") + 1)
    return rows.filter(F.col("age").between(BEGIN, RETIRE)).withColumn("agebin", five_year_bins(F.col("age")))


def imputation_coefficients(persons: DataFrame, first: int, year: int, floors: Mapping[int, float], caps: Mapping[int, float], slots: int = SLOTS) -> DataFrame:
    """agebin, q, n, b0 and b_<feature> of each age group and slot, fitted in `year`."""
    income = at_base("selfinc", 0, first)
    rows = person_years(persons, [year]).filter(income >= float(caps[year]))
    rows = rows.select("agebin", F.ln(income).alias("ln_self"), *[c.alias(n) for c, n in zip(features(first, floors, caps), names(), strict=True)])
    return quantile_regressions(rows, ["agebin"], "ln_self", names(), [(k - 0.5) / slots for k in range(1, slots + 1)])


def coefficient_array(coefficients: DataFrame) -> tuple[Column, int]:
    """age group -> slot -> eighteen numbers, as a literal, and the number of slots; groups without a fit are empty."""
    found = coefficients.select("agebin", "q", "b0", *[f"b_{n}" for n in names()]).limit(MOST // 18 + 1).collect()
    if len(found) > MOST // 18:
        raise ValueError("too many coefficients for one array")
    groups = {}
    for r in sorted(found, key=lambda r: (r["agebin"], r["q"])):
        groups.setdefault(r["agebin"], []).append(F.array(*[F.lit(float(v)) for v in r[2:]]))
    empty = F.array().cast("array<array<double>>")
    whole = F.array(*[F.array(*groups[g]) if g in groups else empty for g in range(1, max(groups, default=1) + 1)])
    return whole, max(map(len, groups.values()), default=1)


def imputed_incomes(persons: DataFrame, coefficients: DataFrame, first: int, years: Sequence[int], fit_year: int, floors: Mapping[int, float], caps: Mapping[int, float], seed: str = "slot") -> DataFrame:
    """id, yr, selfinc, imputed."""
    tensor, slots = coefficient_array(coefficients)
    scale = F.create_map(*[F.lit(x) for t in years for x in (int(t), float(caps[t]))])[F.col("base").cast("int")]
    slot = F.floor(md5_uniform(seed, F.col("id")) * slots).cast("int")
    own = F.get(F.get(tensor, (F.col("agebin") - 1).cast("int")), slot)
    rows = person_years(persons, years).withColumn("_self", at_base("selfinc", 0, first)).filter("_self is not null")
    rows = rows.withColumn("_x", F.array(F.lit(1.0), *features(first, floors, caps))).withColumn("_b", own)
    predicted = F.exp(F.aggregate(F.zip_with("_x", "_b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)) * scale / float(caps[fit_year])
    imputed = F.when((F.col("_self") > scale) & F.col("_b").isNotNull(), F.greatest(F.col("_self"), predicted)).otherwise(F.col("_self"))
    return rows.select("id", F.col("base").alias("yr"), F.col("_self").alias("selfinc"), imputed.alias("imputed"))
