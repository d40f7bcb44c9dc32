"""Distance between simulated and target moments: scale-robust deviations, group weights, and the objective as a Spark plan over tidy
moment tables or as a function for one vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.plans import panel_moments, simulation

# Weight of each moment group, and what an impossible evaluation costs.
WEIGHTS = {"var_lny": 5.0, "emp_cdf": 5.0, "ssk_l1": 3.0, "ssk_l5": 3.0, "ir": 1.0, "incgrowth": 1.0}
FAILED = 1e20
SCALE_FLOOR = 1e-12
CELL = ["grp", "i", "j", "k", "l"]


def weighted_targets(targets: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """targets with psi (10th percentile of the absolute target within its group, at least a floor) and w (group weight over the
    group's size). Moment tables have bounded size, so the group table is broadcast."""
    table = targets.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "grp string, weight double")
    groups = targets.groupBy("grp").agg(F.greatest(F.percentile(F.abs("value"), 0.10), F.lit(SCALE_FLOOR)).alias("psi"), F.count(F.lit(1)).alias("size"))
    return targets.join(F.broadcast(groups.join(table, "grp", "left")), "grp").withColumn("w", F.coalesce("weight", F.lit(1.0)) / F.col("size")).drop("weight", "size")


def deviations(moments: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells with f = (d - m) / ((|d| + |m|) / 2 + psi) and w."""
    d = moments.select(*CELL, F.col("value").alias("d"))
    return targets.join(d, CELL, "left").withColumn("f", (F.col("d") - F.col("value")) / ((F.abs("d") + F.abs("value")) / 2 + F.col("psi")))


def objective_value(moments: DataFrame, targets: DataFrame) -> DataFrame:
    """One row q: the weighted sum of squares; a missing moment makes it the failure value."""
    return deviations(moments, targets).agg(F.when(F.count(F.when(F.col("f").isNull(), 1)) > 0, F.lit(FAILED)).otherwise(F.sum(F.col("w") * F.col("f") * F.col("f"))).alias("q"))


class Problem:
    """A sub-problem over some free parameters; the others stay at `base`. Targets are moment tensors by group."""

    def __init__(self, free: Sequence[str], targets: Mapping[str, np.ndarray], n: int, steps: int = simulation.STEPS, seed: int = 42, base: np.ndarray | None = None, weights: Mapping[str, float] = WEIGHTS):
        unknown = [x for x in free if x not in simulation.NAMES]
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        self.free, self.n, self.steps, self.seed = list(free), n, steps, seed
        self.at = [simulation.NAMES.index(x) for x in free]
        self.base = np.array(simulation.TRUTH if base is None else base, float)
        self.bounds = simulation.BOUNDS[self.at]
        self.groups = sorted(targets)
        self.m = np.concatenate([np.ravel(targets[g]) for g in self.groups])
        self.psi = np.concatenate([np.full(np.size(targets[g]), max(float(np.percentile(np.abs(targets[g]), 10)), SCALE_FLOOR)) for g in self.groups])
        self.w = np.concatenate([np.full(np.size(targets[g]), weights.get(g, 1.0) / np.size(targets[g])) for g in self.groups])

    @classmethod
    def synthetic(cls, free: Sequence[str], n: int, steps: int = simulation.STEPS, seed: int = 42, **options) -> Problem:
        """Targets simulated at the published estimates with the same shocks."""
        return cls(free, panel_moments.moment_vector(simulation.simulate(simulation.TRUTH, simulation.shocks(n, steps, seed))), n, steps, seed, **options)

    def theta(self, x: Sequence[float]) -> np.ndarray:
        out = self.base.copy()
        out[self.at] = np.clip(x, self.bounds[:, 0], self.bounds[:, 1])
        return out

    def __call__(self, x: Sequence[float]) -> float:
        y = simulation.simulate(self.theta(x), simulation.shocks(self.n, self.steps, self.seed))
        found = panel_moments.moment_vector(y)
        d = np.concatenate([np.ravel(found[g]) for g in self.groups])
        if d.shape != self.m.shape or not np.isfinite(d).all():
            return FAILED
        f = (d - self.m) / ((np.abs(d) + np.abs(self.m)) / 2 + self.psi)
        return float(self.w @ f**2)


def evaluated(points: DataFrame, problem: Callable[[Sequence[float]], float]) -> DataFrame:
    """i, x, f for a table of points: any callable, shipped once per task. Failures give the failure value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for x in batch.column("x").to_pylist():
                try:
                    values.append(float(problem(x)))
                except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                    values.append(FAILED)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), pa.array(values, pa.float64())], names=["i", "x", "f"])

    return points.select("i", "x").mapInArrow(run, "i long, x array<double>, f double")
