"""Global search: Sobol screening, the best starts, rounds of blended local searches, and a last polish. Evaluations are Spark tasks; the
driver only ranks bounded tables and passes the best point between rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.filters import legitimate
from cohortlake.plans.objective import evaluated

# Fixed values: (degree, inner coefficients, first direction numbers) of the published Sobol sequence, dimensions 2 to 21.
DIRECTIONS = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)), (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)), (6, 22, (1, 3, 1, 15, 13, 25)), (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)
WORD = 32


def direction_numbers(dimension: int) -> list[int]:
    """WORD direction numbers of one dimension (from 0), as integers of WORD bits."""
    if dimension == 0:
        return [1 << (WORD - 1 - k) for k in range(WORD)]
    degree, inner, first = DIRECTIONS[dimension - 1]
    v = [m << (WORD - 1 - k) for k, m in enumerate(first)]
    for k in range(degree, WORD):
        new = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= v[k - j]
        v.append(new)
    return v


def sobol_points(spark: SparkSession, count: int, bounds: np.ndarray, seed: int | None = 999, skip: int = 1) -> DataFrame:
    """i, x: points of the Gray-code sequence scaled to the bounds, with a random digital shift if a seed is given. Point i is a sum
    (exclusive or) over the set bits of i's Gray code, so every row computes its own."""
    dims = len(bounds)
    if dims > len(DIRECTIONS) + 1:
        raise ValueError(f"at most {len(DIRECTIONS) + 1} dimensions")
    shift = np.random.default_rng(seed).integers(0, 1 << WORD, dims) if seed is not None else np.zeros(dims, int)
    gray = F.col("n").bitwiseXOR(F.shiftright("n", 1))
    columns = []
    for d, (low, high) in enumerate(bounds):
        numbers = F.array(*[F.lit(v).cast("bigint") for v in direction_numbers(d)])
        bits = F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(int(shift[d])).cast("bigint"), _fold(numbers))
        columns.append(F.lit(float(low)) + (bits / float(1 << WORD)) * float(high - low))
    return spark.range(count).withColumn("n", F.col("id") + skip).withColumn("g", gray).select(F.col("id").alias("i"), F.array(*columns).alias("x"))


def _fold(numbers):
    def step(acc, k):
        on = F.expr("1L").cast("bigint")
        return acc.bitwiseXOR(F.when(F.call_function("shiftright", F.col("g"), k).bitwiseAND(on) == 1, F.get(numbers, k)).otherwise(F.lit(0).cast("bigint")))

    return step


def starts(screened: DataFrame, keep: int, most: float = 1e8, distinct: bool = False) -> DataFrame:
    """The best points with legitimate values, in order; `distinct` drops repeated values first."""
    rows = screened.filter(legitimate(F.col("f"), most))
    if distinct:
        rows = rows.groupBy("f").agg(F.min_by(F.struct("i", "x"), "i").alias("r")).select("r.i", "r.x", "f")
    return rows.orderBy("f", "i").limit(keep)


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, bounds: np.ndarray, maxiter: int, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Downhill simplex within bounds (points are clipped)."""
    dims, span = len(start), bounds[:, 1] - bounds[:, 0]
    clip = lambda x: np.clip(x, bounds[:, 0], bounds[:, 1])
    points = [clip(np.asarray(start, float))]
    for d in range(dims):
        step = np.zeros(dims)
        step[d] = 0.05 * span[d] * (1 if points[0][d] + 0.05 * span[d] <= bounds[d, 1] else -1)
        points.append(clip(points[0] + step))
    values = [f(x) for x in points]
    for _ in range(maxiter):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tol * (1e-12 + abs(values[0])) or max(np.max(np.abs(p - points[0]) / span) for p in points[1:]) < 1e-7:
            break
        middle = np.mean(points[:-1], axis=0)
        along = lambda t: clip(middle + t * (points[-1] - middle))  # noqa: B023, E731
        trial = along(-1.0)
        value = f(trial)
        if value < values[0]:
            further = along(-2.0)
            best = f(further)
            points[-1], values[-1] = (further, best) if best < value else (trial, value)
        elif value < values[-2]:
            points[-1], values[-1] = trial, value
        else:
            inner = along(0.5 if value >= values[-1] else -0.5)
            best = f(inner)
            if best < min(value, values[-1]):
                points[-1], values[-1] = inner, best
            else:
                points = [points[0]] + [clip(points[0] + 0.5 * (p - points[0])) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], float(values[k])


def powell(f: Callable[[np.ndarray], float], start: np.ndarray, bounds: np.ndarray, maxiter: int, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Conjugate directions with golden-section line searches inside the bounds."""
    x, value = np.clip(start, bounds[:, 0], bounds[:, 1]), f(np.clip(start, bounds[:, 0], bounds[:, 1]))
    directions = list(np.diag((bounds[:, 1] - bounds[:, 0]) * 0.25))
    golden, used = (np.sqrt(5) - 1) / 2, 0

    def line(x: np.ndarray, value: float, d: np.ndarray) -> tuple[np.ndarray, float]:
        nonlocal used
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(d != 0, np.stack([(bounds[:, 0] - x) / d, (bounds[:, 1] - x) / d]), np.nan)
        low, high = max(-1.0, np.nanmax(np.minimum(*t))), min(1.0, np.nanmin(np.maximum(*t)))
        a, b = high - golden * (high - low), low + golden * (high - low)
        fa, fb = f(x + a * d), f(x + b * d)
        while high - low > 1e-3 and used < maxiter:
            used += 1
            if fa < fb:
                high, b, fb = b, a, fa
                a = high - golden * (high - low)
                fa = f(x + a * d)
            else:
                low, a, fa = a, b, fb
                b = low + golden * (high - low)
                fb = f(x + b * d)
        t_best, best = (a, fa) if fa < fb else (b, fb)
        return (x + t_best * d, best) if best < value else (x, value)

    while used < maxiter:
        before, old, drops = x.copy(), value, []
        for d in directions:
            last = value
            x, value = line(x, value, d)
            drops.append(last - value)
        if old - value <= tol * (abs(old) + 1e-12):
            break
        whole = x - before
        if np.any(whole):
            x, value = line(x, value, whole)
            directions[int(np.argmax(drops))] = whole
    return x, value


def local_search(f: Callable[[np.ndarray], float], start: Sequence[float], bounds: np.ndarray, maxiter: int) -> tuple[np.ndarray, float]:
    """Powell, then Nelder-Mead from where it ends; half of the budget each."""
    x, _ = powell(f, np.asarray(start, float), bounds, max(1, maxiter // 2))
    return nelder_mead(f, x, bounds, max(1, maxiter - maxiter // 2))


def blend(k: int, total: int, low: float = 0.1, high: float = 0.995, ramp: str = "sqrt") -> float:
    """Weight of the best point so far in the k-th start (from 0)."""
    share = (k + 1) / total
    return float(min(max(low, np.sqrt(share) if ramp == "sqrt" else share), high))


def refined(points: DataFrame, problem: Callable[[Sequence[float]], float], bounds: np.ndarray, maxiter: int) -> DataFrame:
    """i, x, f after a local search from each row's x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [local_search(problem, x, bounds, maxiter) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([v for _, v in found], pa.float64())], names=["i", "x", "f"])

    return points.select("i", "x").mapInArrow(run, "i long, x array<double>, f double")


def minimise(spark: SparkSession, problem: Callable[[Sequence[float]], float], bounds: np.ndarray, draws: int = 256, keep: int = 8, maxiter: int = 150, batch: int = 4, seed: int = 999, ramp: str = "sqrt") -> dict:
    """The whole search. Local searches run in rounds of `batch`; each round's starts are blended with the best point so far."""
    tasks = max(1, min(draws, spark.sparkContext.defaultParallelism * 2))
    screened = evaluated(sobol_points(spark, draws, bounds, seed).repartition(tasks), problem)
    first = [(list(r["x"]), r["f"]) for r in starts(screened, keep).collect()]
    if not first:
        raise ValueError("no point of the screening has a finite value")
    best_x, best_f = first[0]
    history = []
    for at in range(0, len(first), batch):
        rows = []
        for k in range(at, min(at + batch, len(first))):
            w = blend(k, len(first), ramp=ramp) if k else 0.0
            rows.append((k, [float(w * b + (1 - w) * s) for b, s in zip(best_x, first[k][0], strict=True)]))
        done = refined(spark.createDataFrame(rows, "i long, x array<double>").repartition(len(rows)), problem, bounds, maxiter).collect()
        for r in done:
            history.append({"k": r["i"], "x": list(r["x"]), "f": r["f"]})
            if r["f"] < best_f:
                best_x, best_f = list(r["x"]), r["f"]
    polished, value = nelder_mead(problem, np.array(best_x), bounds, maxiter)
    if value < best_f:
        best_x, best_f = polished.tolist(), value
    return {"x": best_x, "f": best_f, "screened": draws, "local": history}


def recovery(spark: SparkSession, names: Sequence[str], estimate: Sequence[float], truth: Sequence[float]) -> DataFrame:
    rows = [(n, float(e), float(t), float(e) - float(t)) for n, e, t in zip(names, estimate, truth, strict=True)]
    return spark.createDataFrame(rows, "parameter string, estimate double, truth double, error double")


def objective_slices(spark: SparkSession, problem: Callable[[Sequence[float]], float], at: Sequence[float], names: Sequence[str], bounds: np.ndarray, grid: int = 11) -> DataFrame:
    """parameter, value, f: the objective along each parameter with the others at `at`."""
    rows = []
    for d, (low, high) in enumerate(bounds):
        for v in np.linspace(low, high, grid):
            x = list(map(float, at))
            x[d] = float(v)
            rows.append((len(rows), names[d], float(v), x))
    points = spark.createDataFrame(rows, "i long, parameter string, value double, x array<double>")
    found = evaluated(points.repartition(min(len(rows), spark.sparkContext.defaultParallelism)), problem)
    return points.drop("x").join(found.select("i", "f"), "i").select("parameter", "value", "f")
