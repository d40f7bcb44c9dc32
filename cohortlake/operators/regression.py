"""Regression, imputation and resampling. Least squares over dummies or powers reduces to sums that Spark gathers; only the small
normal equations reach the driver. Fits without such sums run per group through Arrow."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.quantiles import ranked
from cohortlake.functions.scalar import md5_uniform
from cohortlake.session import staged


def dummy_least_squares(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """factor, level, coef of y on dummies of a (all levels) and b (all but its first), without a constant. The cells' counts and
    sums are sufficient: at most levels(a) x levels(b) rows are collected."""
    cells = df.filter(F.col(y).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")).collect()
    la, lb = sorted({r[0] for r in cells}), sorted({r[1] for r in cells})
    at_a, at_b = {v: i for i, v in enumerate(la)}, {v: len(la) + i - 1 for i, v in enumerate(lb) if i}
    size = len(la) + max(0, len(lb) - 1)
    xx, xy = np.zeros((size, size)), np.zeros(size)
    for va, vb, n, s in cells:
        own = [at_a[va], *([at_b[vb]] if vb in at_b else [])]
        for i in own:
            xy[i] += s
            for j in own:
                xx[i, j] += n
    coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
    rows = [(a, int(v), float(coef[i])) for v, i in at_a.items()] + [(b, int(v), float(coef[i])) for v, i in at_b.items()]
    return df.sparkSession.createDataFrame(rows, "factor string, level long, coef double")


def polynomial_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int = 3) -> DataFrame:
    """keys, n, b0..bd by power sums, one row per group through the small solver. x is centred at its overall middle."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(F.pow(F.col(x), F.lit(k))).alias(f"x{k}") for k in range(1, 2 * degree + 1)] + [F.sum(F.col(y) * F.pow(F.col(x), F.lit(k))).alias(f"y{k}") for k in range(degree + 1)]
    small = rows.groupBy(*keys).agg(*sums)
    names = [f"b{k}" for k in range(degree + 1)]

    def solve(batches):
        for pdf in batches:
            out = pdf[[*keys, "n"]].copy()
            found = np.full((len(pdf), degree + 1), np.nan)
            for r, row in enumerate(pdf.to_dict("records")):
                power = [row["n"], *[row[f"x{k}"] for k in range(1, 2 * degree + 1)]]
                if row["n"] > degree:
                    found[r] = np.linalg.lstsq(np.array([[power[i + j] for j in range(degree + 1)] for i in range(degree + 1)], float), np.array([row[f"y{k}"] for k in range(degree + 1)], float), rcond=None)[0]
            for k, name in enumerate(names):
                out[name] = found[:, k]
            yield out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in small.schema.fields if f.name in keys] + ["n long"] + [f"{n} double" for n in names])
    return small.mapInPandas(solve, schema)


def simple_least_squares(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def residuals_by_group(df: DataFrame, key: str, y: str, factors: Sequence[str], name: str = "resid") -> DataFrame:
    """Residuals of y on dummies of all factors within each key: fully interacted with the key, so each key is one small problem
    solved from its cells' sums; the fitted values come back by a join, and no group is gathered in one task."""
    keys = [key, *factors]
    cells = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.ones((len(pdf), 1)), *[pd.get_dummies(pdf[f], drop_first=True, dtype=float).to_numpy() for f in factors]], axis=1)
        w = np.sqrt(pdf["n"].to_numpy(float))
        coef = np.linalg.lstsq(x * w[:, None], pdf["m"].to_numpy() * w, rcond=None)[0]
        return pdf[keys].assign(fitted=x @ coef)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fitted = cells.groupBy(key).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fitted double")
    return df.join(fitted, keys, "left").withColumn(name, F.col(y) - F.col("fitted")).drop("fitted")


def imputed(df: DataFrame, coefficients: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], topcoded: str, slots: int, seed: str, name: str = "y_imputed") -> DataFrame:
    """Where topcoded holds: a pseudo-random quantile slot of the row picks coefficients (keys, slot, b0, b_<x>), whose prediction
    counts, but never less than what is observed. Coefficients have groups x slots rows."""
    drawn = df.withColumn("slot", (F.floor(md5_uniform(seed, F.col("id"), F.col("yr")) * slots) + 1).cast("long"))
    joined = drawn.join(coefficients, [*keys, "slot"], "left")
    predicted = F.col("b0")
    for x in xs:
        predicted = predicted + F.col(f"b_{x}") * F.col(x)
    return joined.withColumn(name, F.when(F.col(topcoded), F.greatest(F.col(y), predicted)).otherwise(F.col(y))).drop("b0", *[f"b_{x}" for x in xs], "slot")


def hash_sample(df: DataFrame, share: float, seed: str, *keys: str) -> DataFrame:
    return df.filter(md5_uniform(seed, *[F.col(k) for k in keys]) < share)


#: Digits of a digest: a uniform number of md5_uniform is a whole number of 2**-48.
DIGEST_STEPS = 1 << 48


def poisson_cuts(most: int | None = None) -> list[float]:
    """Cumulative probabilities of Poisson(1) counts from 0 on, as far as a digest's numbers reach; at most `most` of them, if given."""
    cumulative, term, cuts = 0.0, float(np.exp(-1)), []
    while cumulative <= 1 - 1 / DIGEST_STEPS and (most is None or len(cuts) < most):
        cumulative += term
        cuts.append(cumulative)
        term /= len(cuts)
    return cuts


def bootstrap(df: DataFrame, replicates: int, id_: str = "id", seed: str = "boot", most: int | None = None) -> DataFrame:
    """Rows of each person as often as each replicate draws them: independent Poisson(1) counts from a digest of (replicate,
    person), so a person's rows go together and no index of persons is needed. `most`, if given, is the largest count. Column rep."""
    reps = df.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "rep")
    cuts = poisson_cuts(most)
    people = df.select(id_).distinct().crossJoin(F.broadcast(reps))
    times = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= md5_uniform(seed, F.col("rep"), F.col(id_))))
    drawn = people.withColumn("_times", times).filter("_times > 0")
    return df.join(drawn, id_).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def replicate_weights(people: DataFrame, replicates: int, id_: str = "id", seed: str = "draw") -> DataFrame:
    """id and w, an array of how often each of the replicates draws the person, in exactly as many draws as there are persons. Persons
    are numbered in the order of their ids; draw j of a replicate takes the number that a digest of (replicate, j) points at, so draws
    are made in any task and counted before they meet their person. Persons that no replicate draws have zeros."""
    numbered = staged(ranked(people.select(id_).distinct(), [], [id_]).select(id_, (F.col("_k") - 1).alias("_number"), "_n"), "numbered")
    n = numbered.count()
    draws = people.sparkSession.range(n * replicates).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("_rep"), (F.col("id") % max(n, 1)).alias("_draw"))
    drawn = draws.select("_rep", F.floor(md5_uniform(seed, F.col("_rep") + 1, F.col("_draw")) * n).alias("_number"))
    counts = drawn.groupBy("_number").agg(F.array(*[F.count(F.when(F.col("_rep") == r, 1)) for r in range(replicates)]).alias("w"))
    return numbered.join(counts, "_number", "left").select(id_, F.coalesce("w", F.array_repeat(F.lit(0).cast("bigint"), replicates)).alias("w"))


def autocovariance_errors(panel: DataFrame, value: str, key: str, replicates: int, max_lag: int | None = None, id_: str = "id", seed: str = "draw") -> DataFrame:
    """key_a <= key_b, reps, mean and se of the autocovariances over bootstrap replicates of persons, and the mean number of persons.
    All replicates come from one pass over the pairs, as sums under each replicate's weights."""
    rows = staged(panel.filter(F.col(value).isNotNull()).select(id_, F.col(key).alias("_key"), F.col(value).alias("_v")), "autocovariance")
    weights = replicate_weights(panel, replicates, id_, seed)
    years = rows.groupBy(id_).agg(F.collect_list(F.struct("_key", "_v")).alias("_at"))  # a person's years
    held = years.join(weights, id_)
    pairs = held.select("w", F.explode("_at").alias("a"), "_at").select("w", "a", F.explode("_at").alias("b")).select("w", F.col("a._key").alias("key_a"), F.col("b._key").alias("key_b"), F.col("a._v").alias("a"), F.col("b._v").alias("b"))
    pairs = pairs.filter("key_a <= key_b" + (f" and key_b - key_a <= {max_lag}" if max_lag is not None else ""))
    w = lambda r: F.col("w")[r]
    sums = [F.sum(w(r) * x).alias(f"{name}{r}") for r in range(replicates) for name, x in (("n", F.lit(1)), ("a", F.col("a")), ("b", F.col("b")), ("ab", F.col("a") * F.col("b")))]
    found = pairs.groupBy("key_a", "key_b").agg(*sums)
    c = lambda name, r: F.col(f"{name}{r}")
    each = [F.struct(c("n", r).cast("double").alias("n"), F.when(c("n", r) > 1, (c("ab", r) - c("a", r) * c("b", r) / c("n", r)) / (c("n", r) - 1)).alias("cov")) for r in range(replicates)]
    long = found.select("key_a", "key_b", F.explode(F.array(*each)).alias("x")).select("key_a", "key_b", "x.*").filter("cov is not null")
    errors = replicate_errors(long, ["key_a", "key_b"], "cov")
    return errors.join(long.groupBy("key_a", "key_b").agg(F.avg("n").alias("persons")), ["key_a", "key_b"])


def replicate_errors(stats: DataFrame, keys: Sequence[str], value: str, population: bool = False) -> DataFrame:
    """keys, mean, se over replicates: se is the standard deviation over the root of their number."""
    sd = F.stddev_pop(value) if population else F.stddev_samp(value)
    return stats.groupBy(*keys).agg(F.count(value).alias("reps"), F.avg(value).alias("mean"), (sd / F.sqrt(F.count(value))).alias("se"))


def loess(df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.4) -> DataFrame:
    """Local linear smoothing with tricube weights over each group's points (percentile tables of a hundred rows)."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys] + [f"{x} double", "smooth double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        n = max(2, int(np.ceil(span * len(xs))))
        out = np.empty(len(xs))
        for i, at in enumerate(xs):
            d = np.abs(xs - at)
            reach = np.sort(d)[min(n, len(d)) - 1] or 1.0
            w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
            sw, sx = w.sum(), (w * (xs - at)).sum()
            sxx, sy, sxy = (w * (xs - at) ** 2).sum(), (w * ys).sum(), (w * (xs - at) * ys).sum()
            det = sw * sxx - sx * sx
            out[i] = (sxx * sy - sx * sxy) / det if abs(det) > 1e-12 else sy / sw
        return pdf[list(keys)].assign(**{x: xs, "smooth": out})

    return df.groupBy(*keys).applyInPandas(fit, schema)


def reference_normalised(df: DataFrame, keys: Sequence[str], bin_: str, value: str, reference: int, name: str) -> DataFrame:
    """The value less the one of the reference bin within keys."""
    base = df.filter(F.col(bin_) == reference).select(*keys, F.col(value).alias("_base"))
    return df.join(base, list(keys), "left").withColumn(name, F.col(value) - F.col("_base")).drop("_base")
