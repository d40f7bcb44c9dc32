"""The income process: frozen shocks, simulation as a fold inside the row for one parameter vector, and as a numpy kernel for many.

Log income at step h = 1.. (s = h / 10): a0 + a1 s + a2 s^2 + alpha + beta s + z_h + eps_h, with correlated person effects (alpha, beta),
a persistent z with mixture innovations, mixture transitory eps, and a share of the year without work whose chance depends on s and z.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameter names, the published estimates, and bounds, in the order of the parameter vector.
PARAMETERS = {
    "a0": (2.580861694, 0.0, 5.0),
    "a1": (0.811530031, -2.0, 3.0),
    "a2": (-0.185093302, -1.0, 1.0),
    "sigma_alpha": (0.299819619, 0.01, 1.0),
    "sigma_beta": (0.196328895, 0.01, 1.0),
    "corr_ab": (0.767749193, -0.99, 0.99),
    "rho1": (0.959229453, 0.5, 0.999),
    "sd_z0": (0.713648178, 0.05, 2.0),
    "pdf_ar": (0.406559194, 0.01, 0.99),
    "mu_eta1": (-0.085236482, -1.0, 1.0),
    "sd_eta1": (0.363928061, 0.01, 1.0),
    "sd_eta2": (0.06891405, 0.001, 0.5),
    "pr_eps": (0.129904327, 0.01, 0.5),
    "mu_eps1": (0.271112226, -1.0, 1.0),
    "sd_eps1": (0.284541004, 0.01, 1.0),
    "sd_eps2": (0.036545913, 0.001, 0.3),
    "nu_const": (-3.352949544, -10.0, 0.0),
    "nu_age": (-0.859498283, -5.0, 5.0),
    "nu_z": (-5.034075647, -15.0, 0.0),
    "nu_inter": (-2.895204912, -10.0, 5.0),
    "nu_lam": (0.000265509, 1e-6, 0.01),
}
NAMES = list(PARAMETERS)
TRUTH = np.array([v[0] for v in PARAMETERS.values()])
BOUNDS = np.array([v[1:] for v in PARAMETERS.values()])
STEPS = 36
YEARLY = ("p_ar", "eta", "unemp", "nu", "p_eps", "eps")
NORMAL = {"eta", "eps"}


@lru_cache(maxsize=4)
def shocks(n: int, steps: int = STEPS, seed: int = 42) -> Mapping[str, np.ndarray]:
    """Common random numbers: three person vectors, then for each step six vectors in a fixed order, from one PCG64 stream."""
    rng = np.random.default_rng(seed)
    out = {name: rng.standard_normal(n) for name in ("hip1", "hip2", "z0")}
    draws = [[rng.standard_normal(n) if name in NORMAL else rng.uniform(size=n) for name in YEARLY] for _ in range(steps)]
    return out | {name: np.array([step[k] for step in draws]) for k, name in enumerate(YEARLY)}


def shock_rows(spark: SparkSession, n: int, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """id, hip1, hip2, z0 and one array per yearly shock."""
    s = shocks(n, steps, seed)
    columns = {"id": pa.array(np.arange(n)), **{k: pa.array(s[k]) for k in ("hip1", "hip2", "z0")}}
    columns |= {k: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(s[k].T).ravel()), steps).cast(pa.list_(pa.float64())) for k in YEARLY}
    return spark.createDataFrame(pa.table(columns))


def derived(theta: Mapping[str, float]) -> dict[str, float]:
    """Means of the second mixture parts (each shock has mean zero) and the factor of the person effects."""
    below = theta["corr_ab"] * theta["sigma_beta"]
    return {
        "mu_eta2": -theta["mu_eta1"] * theta["pdf_ar"] / (1 - theta["pdf_ar"]),
        "mu_eps2": -theta["mu_eps1"] * theta["pr_eps"] / (1 - theta["pr_eps"]),
        "on_first": below,
        "on_second": float(np.sqrt(max(theta["sigma_beta"] ** 2 - below**2, 1e-15))),
    }


def simulated(rows: DataFrame, theta: Mapping[str, float] | None = None) -> DataFrame:
    """id, y: the panel of one parameter vector, folded over each person's shocks inside the row: no shuffle, no Python."""
    t = {**(theta or {k: v[0] for k, v in PARAMETERS.items()})}
    t |= derived(t)
    lit = {k: F.lit(float(v)) for k, v in t.items()}
    alpha = lit["sigma_alpha"] * F.col("hip1")
    beta = lit["on_first"] * F.col("hip1") + lit["on_second"] * F.col("hip2")

    def step(acc: Column, x: Column) -> Column:
        s = x["h"] / 10
        first = x["p_ar"] <= lit["pdf_ar"]
        z = lit["rho1"] * acc["z"] + F.when(first, lit["mu_eta1"] + lit["sd_eta1"] * x["eta"]).otherwise(lit["mu_eta2"] + lit["sd_eta2"] * x["eta"])
        xi = F.least(F.greatest(lit["nu_const"] + lit["nu_age"] * s + lit["nu_z"] * z + lit["nu_inter"] * s * z, F.lit(-500.0)), F.lit(500.0))
        idle = F.when(x["unemp"] <= 1 / (1 + F.exp(-xi)), F.least(-F.ln(F.greatest(x["nu"], F.lit(1e-15))) / F.greatest(lit["nu_lam"], F.lit(1e-15)), F.lit(1.0))).otherwise(0.0)
        eps = F.when(x["p_eps"] <= lit["pr_eps"], lit["mu_eps1"] + lit["sd_eps1"] * x["eps"]).otherwise(lit["mu_eps2"] + lit["sd_eps2"] * x["eps"])
        y = F.greatest(F.lit(0.0), (1 - idle) * F.exp(lit["a0"] + lit["a1"] * s + lit["a2"] * s * s + alpha + beta * s + z + eps))
        return F.struct(z.alias("z"), F.concat(acc["y"], F.array(y)).alias("y"))

    years = F.transform(F.arrays_zip(*YEARLY), lambda x, i: F.struct((i + 1).cast("double").alias("h"), *[x[k].alias(k) for k in YEARLY]))
    start = F.struct((lit["sd_z0"] * F.col("z0")).alias("z"), F.array().cast("array<double>").alias("y"))
    return rows.select("id", F.aggregate(years, start, step, lambda acc: acc["y"]).alias("y"))


def simulate(theta: np.ndarray, s: Mapping[str, np.ndarray]) -> np.ndarray:
    """(n, steps) panel of one parameter vector in numpy: everything but the recursion of z is one array expression."""
    t = dict(zip(NAMES, map(float, theta), strict=True))
    t |= derived(t)
    steps = s["eta"].shape[0]
    pushes = np.where(s["p_ar"] <= t["pdf_ar"], t["mu_eta1"] + t["sd_eta1"] * s["eta"], t["mu_eta2"] + t["sd_eta2"] * s["eta"])
    z, now = np.empty_like(pushes), t["sd_z0"] * s["z0"]
    for h in range(steps):
        now = t["rho1"] * now + pushes[h]
        z[h] = now
    age = (np.arange(1, steps + 1) / 10)[:, None]
    chance = 1 / (1 + np.exp(-np.clip(t["nu_const"] + t["nu_age"] * age + (t["nu_z"] + t["nu_inter"] * age) * z, -500, 500)))
    idle = np.where(s["unemp"] <= chance, np.minimum(-np.log(np.maximum(s["nu"], 1e-15)) / max(t["nu_lam"], 1e-15), 1), 0)
    eps = np.where(s["p_eps"] <= t["pr_eps"], t["mu_eps1"] + t["sd_eps1"] * s["eps"], t["mu_eps2"] + t["sd_eps2"] * s["eps"])
    person = t["sigma_alpha"] * s["hip1"] + (t["on_first"] * s["hip1"] + t["on_second"] * s["hip2"]) * age
    return np.maximum(0, (1 - idle) * np.exp(t["a0"] + t["a1"] * age + t["a2"] * age**2 + person + z + eps)).T


def simulated_for(thetas: DataFrame, n: int, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """i, id, y for a table of parameter vectors (i, x): each task redraws the frozen shocks once and simulates its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shocks(n, steps, seed)
        for batch in batches:
            for i, x in zip(batch.column("i").to_pylist(), batch.column("x").to_pylist(), strict=True):
                y = simulate(np.array(x), s)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, steps, dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(np.arange(n)), lists], names=["i", "id", "y"])

    return thetas.select("i", "x").mapInArrow(run, "i long, id long, y array<double>")
