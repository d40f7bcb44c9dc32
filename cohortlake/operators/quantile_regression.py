"""Linear quantile regressions of groups of any size, all groups and quantiles at once.

The check loss is |r| / 2 + (q - 1/2) r. In groups of more than `band` distinct rows its first part is rounded within gamma of zero, which
makes it differentiable. A round is one pass: tasks add up, for every group and quantile, the loss, its slopes, the curvature of the rows
within gamma, and the curvature of a parabola that lies above the loss; from the sums follow the points that the next round tries
together, shares of a Newton step and the parabola's step, which never makes the loss larger. gamma shrinks until few rows lie within it.

Then only rows near the fit can change sides. They go to one task for each group and quantile, at most about `band` of them, with the
summed slopes of all others, whose side is taken as settled; that small problem is solved exactly. One more pass counts rows that
were taken on the wrong side; while there are any, the band is drawn anew around the better fit and made wider. Without any, the fit is
the minimum over all rows.

Only sums and coefficients reach the driver, whatever the number of rows. Equal rows are merged first, with their number. Rows with a
null in y or a regressor are left out; null keys are groups like others. Where several fits are equally good, one of them is returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.quantiles import null_safe
from cohortlake.session import staged

#: Numbers that the sums of one round may have, and points that it tries for each fit.
MOST_SUMS = 1 << 22
POINTS = 8
#: Distinct rows that the last step gathers for a group and quantile.
BAND = 4000
SHRINK = 0.1


def loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, coef: np.ndarray, gamma: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """Per point: loss, rows within gamma, slopes, and the upper triangles of both curvatures."""
    r = y[:, None] - x @ coef.T
    size, tilt, w = np.abs(r), quantiles - 0.5, w[:, None]
    near = size <= gamma
    loss = np.where(near, r * r / (2 * gamma) + gamma / 2, size) / 2 + tilt * r
    slope = np.clip(r / gamma, -1, 1) / 2 + tilt
    a, b = np.triu_indices(x.shape[1])
    products = x[:, a] * x[:, b]
    inner = (w * near / (2 * gamma)).T @ products
    above = (w * 0.5 / np.maximum(size, gamma)).T @ products
    return np.concatenate([(w * loss).sum(axis=0)[:, None], near.sum(axis=0)[:, None], (w * slope).T @ x, inner, above], axis=1)


def square(upper: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


class Fit:
    """The state of one group and quantile: points to try, at least one, and the width of rounding."""

    def __init__(self, coef: np.ndarray, gamma: float, enough: int, smallest: float):
        self.points, self.gamma, self.enough, self.smallest, self.done = coef[None], gamma, enough, smallest, False

    @property
    def coef(self) -> np.ndarray:
        return self.points[0]

    def advance(self, sums: np.ndarray) -> None:
        """Take the best point and set the next ones; done when at most `enough` rows are within gamma, or gamma is smallest."""
        p = self.points.shape[1]
        best = int(np.argmin(sums[:, 0]))
        at, near, slope = self.points[best], sums[best, 1], sums[best, 2 : 2 + p]
        half = p * (p + 1) // 2
        inner, above = square(sums[best, 2 + p : 2 + p + half], p), square(sums[best, 2 + p + half :], p)
        steps = [np.linalg.lstsq(above, slope, rcond=None)[0]]
        if near:
            # rows within gamma may not settle every direction; the parabola adds a little in the others
            newton = [np.linalg.lstsq(inner + e * above, slope, rcond=None)[0] for e in (1e-9, 1e-3)]
            steps = [newton[0], *steps, *(share * newton[0] for share in (0.5, 0.2, 0.05)), newton[1], 4 * steps[0]]
        self.points = np.array([at, *(at + d for d in steps)])
        if np.abs(steps[0]).max() <= max(0.1 * self.gamma, 1e-14 * np.abs(at).max()):
            self.done = near <= self.enough or self.gamma <= self.smallest
            self.gamma *= SHRINK


def exact_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: float, start: np.ndarray, pull: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Coefficients that minimise the check loss of these rows less pull'b. Rounding shrinks to almost nothing; then fits through the p
    nearest rows, and through those with one of them exchanged, are tried for as long as one is better."""
    p = x.shape[1]

    def loss(b: np.ndarray) -> float:
        r = y - x @ b
        return float((w * np.maximum(q * r, (q - 1) * r)).sum() - pull @ b)

    fit = Fit(start, float(np.abs(y - x @ start).max() or 1e-9), 0, float(np.abs(y - x @ start).max() or 1e-9) * 1e-10)
    for _ in range(rounds):
        if fit.done:
            break
        sums = loss_sums(x, y, w, fit.points, np.full(len(fit.points), fit.gamma), np.full(len(fit.points), q))
        sums[:, 0] -= fit.points @ pull
        sums[:, 2 : 2 + p] += pull
        fit.advance(sums)
    best, value = fit.coef, loss(fit.coef)
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ best), kind="stable").tolist():
        if np.linalg.matrix_rank(x[[*basis, i]]) > len(basis):
            basis.append(i)
            if len(basis) == p:
                break
    while basis and len(basis) == p:
        found = np.linalg.solve(x[basis], y[basis])
        if loss(found) < value:
            best, value = found, loss(found)
        near = np.argsort(np.abs(y - x @ best), kind="stable")[: 6 * p].tolist()
        better = None
        for out in range(p):
            for i in near:
                if i not in basis:
                    other = [*basis[:out], i, *basis[out + 1 :]]
                    if np.linalg.matrix_rank(x[other]) == p and loss(np.linalg.solve(x[other], y[other])) < value - 1e-12 * max(1.0, abs(value)):
                        better = other
                        value = loss(np.linalg.solve(x[other], y[other]))
        if better is None:
            return best
        basis, best = better, np.linalg.solve(x[better], y[better])
    return best


def segments(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, x with a constant, y, weights) of a batch's rows."""
    g = batch.column("_g").to_numpy()
    data, w = batch.column("_x").flatten().to_numpy().reshape(len(g), width), batch.column("_w").to_numpy().astype(float)
    order = np.argsort(g, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
        if len(own):
            yield int(g[own[0]]), np.column_stack([np.ones(len(own)), data[own, 1:]]), data[own, 0], w[own]


def sum_rows(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    out = [(g, at, s) for g, sums in found.items() for at, s in enumerate(sums.tolist())]
    g, at, s = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(at, pa.int32()), pa.array(s, pa.list_(pa.float64()))], names=["g", "at", "s"])


def gathered(rows: DataFrame, sums_of, width: int, length: int) -> dict[tuple[int, int], np.ndarray]:
    """sums_of(group, x, y, w) added over all rows: {(group, line): sums}. Few lines leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, x, y, w in segments(batch, width):
                sums = sums_of(g, x, y, w)
                if sums is not None:
                    found[g] = found[g] + sums if g in found else sums
        yield sum_rows(found)

    parts = rows.mapInArrow(run, "g int, at int, s array<double>")
    zero = F.array_repeat(F.lit(0.0), length)
    # added in a settled order, so that a rerun finds the same
    total = parts.groupBy("g", "at").agg(F.array_sort(F.collect_list("s")).alias("s")).select("g", "at", F.aggregate("s", zero, lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias("s"))
    return {(r["g"], r["at"]): np.array(r["s"]) for r in total.collect()}


def solve_bands(rows: DataFrame, width: int, near: dict[int, tuple[np.ndarray, np.ndarray]], qs: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Exact fits of the rows within each quantile's band, with the slopes of the rows outside. near: group -> (coefficients, widths)
    by quantile; a negative width leaves the fit out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pulls: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, x, y, w in segments(batch, width):
                coef, widths = near[g]
                r = y[:, None] - x @ coef.T
                for k in np.flatnonzero(widths >= 0).tolist():
                    inside = np.abs(r[:, k]) <= widths[k]
                    slope = np.where(r[~inside, k] > 0, qs[k], qs[k] - 1) * w[~inside]
                    pulls[g, k] = pulls.get((g, k), 0) + slope @ x[~inside]
                    if inside.any():
                        data = np.column_stack([y[inside], x[inside, 1:], w[inside]])
                        yield pa.RecordBatch.from_arrays([pa.array([g] * len(data), pa.int32()), pa.array([k] * len(data), pa.int32()), pa.array([False] * len(data)), pa.array(data.tolist(), pa.list_(pa.float64()))], names=["g", "k", "far", "v"])
        far = [(g, k, True, v.tolist()) for (g, k), v in pulls.items()]
        g, k, f, v = zip(*far, strict=True) if far else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.bool_()), pa.array(v, pa.list_(pa.float64()))], names=["g", "k", "far", "v"])

    def solve(table: pa.Table) -> pa.Table:
        g, k = table.column("g")[0].as_py(), table.column("k")[0].as_py()
        far = np.array(table.column("far").to_pylist(), bool)
        values = table.column("v").to_pylist()
        pull = np.array(sorted(v for v, f in zip(values, far, strict=True) if f)).reshape(-1, width).sum(axis=0)
        data = np.array(sorted(v for v, f in zip(values, far, strict=True) if not f)).reshape(-1, width + 1)
        coef = near[g][0][k]
        if len(data):
            coef = exact_fit(np.column_stack([np.ones(len(data)), data[:, 1:-1]]), data[:, 0], data[:, -1], float(qs[k]), coef, pull)
        return pa.table({"g": pa.array([g], pa.int32()), "k": pa.array([k], pa.int32()), "b": pa.array([coef.tolist()], pa.list_(pa.float64()))})

    found = rows.mapInArrow(split, "g int, k int, far boolean, v array<double>").groupBy("g", "k").applyInArrow(solve, "g int, k int, b array<double>")
    return {(r["g"], r["k"]): np.array(r["b"]) for r in found.collect()}


def start_sums(g: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([((x * w[:, None]).T @ x).ravel(), (x * w[:, None]).T @ y, [w @ (y * y), w.sum(), len(y)]])[None]


def quantile_regressions(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], quantiles: Sequence[float], band: int = BAND, rounds: int = 100) -> DataFrame:
    """keys, q, n, b0, b_<x> of each group and quantile."""
    spark, keys, p, qs, kinds = df.sparkSession, list(keys), len(xs) + 1, np.array(quantiles, float), dict(df.dtypes)
    numbers = F.array(*[F.col(c).cast("double") for c in (y, *xs)]).alias("_x")
    rows = df.select(*keys, numbers).filter(F.forall("_x", lambda v: v.isNotNull())).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_w"))
    rows = staged(rows, "regression-input")
    most = max(1, MOST_SUMS // (POINTS * len(qs) * (2 + p + p * (p + 1))))
    groups = rows.select(*keys).distinct().limit(most + 1).collect() if keys else [()] * (not rows.isEmpty())
    if len(groups) > most:
        raise ValueError(f"more than {most} groups for {len(qs)} quantiles and {p} coefficients at once: fit them in parts")
    if keys:
        numbered = spark.createDataFrame([(*g, k) for k, g in enumerate(groups)], ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_g int"]))
        rows = staged(null_safe(rows, F.broadcast(numbered), keys).select("_g", "_x", "_w"), "regression-rows")
    else:
        rows = rows.select(F.lit(0).alias("_g"), "_x", "_w")
    near, sizes, fits = {}, {}, {}
    for (g, _), s in gathered(rows, start_sums, p, p * p + p + 3).items():
        coef = np.linalg.lstsq(s[: p * p].reshape(p, p), s[p * p : p * p + p], rcond=None)[0]
        spread = float(np.sqrt(max(s[-3] - coef @ s[p * p : p * p + p], 0.0) / s[-2])) or max(float(np.abs(coef).max()), 1.0) * 1e-6
        sizes[g], near[g] = int(s[-2]), (np.tile(coef, (len(qs), 1)), np.full(len(qs), np.inf))
        if s[-1] > band:
            fits |= {(g, k): Fit(coef, spread, band // 4, spread * 1e-9) for k in range(len(qs))}
    for _ in range(rounds):
        open_ = {at: f for at, f in fits.items() if not f.done}
        if not open_:
            break
        own = {g: [k for h, k in open_ if h == g] for g in {g for g, _ in open_}}
        coef = {g: np.concatenate([fits[g, k].points for k in ks]) for g, ks in own.items()}
        of = {g: np.repeat(ks, [len(fits[g, k].points) for k in ks]) for g, ks in own.items()}
        gamma = {g: np.array([fits[g, k].gamma for k in ks.tolist()]) for g, ks in of.items()}
        sums = gathered(rows, lambda g, x, v, w: loss_sums(x, v, w, coef[g], gamma[g], qs[of[g]]) if g in coef else None, p, 2 + p + p * (p + 1))  # noqa: B023
        for (g, k), f in open_.items():
            f.advance(np.array([sums[g, at] for at in np.flatnonzero(of[g] == k).tolist()]))
    for (g, k), f in fits.items():
        near[g][0][k], near[g][1][k] = f.coef, 3 * f.gamma / SHRINK
    pending = bool(near)
    while pending:
        solved = solve_bands(rows, p, near, qs)
        after = {g: (np.array([solved.get((g, k), near[g][0][k]) for k in range(len(qs))]), near[g][1]) for g in near}
        if not any(np.isfinite(w[w >= 0]).any() for _, w in near.values()):
            near = after  # every band held its whole group
            break

        def wrong(g: int, x: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
            (old, widths), new = near[g], after[g][0]  # noqa: B023
            r0, r1 = v[:, None] - x @ old.T, v[:, None] - x @ new.T
            return ((np.abs(r0) > widths) & (r0 * r1 < 0)).sum(axis=0).astype(float)[None]

        crossed = gathered(rows, wrong, p, len(qs))
        pending = False
        for g, (coef, widths) in after.items():
            for k in range(len(qs)):
                if widths[k] >= 0 and crossed[g, 0][k] > 0:
                    widths[k], pending = 2 * widths[k], True
                else:
                    widths[k] = -1.0
            near[g] = (coef, widths)
    out = [(*groups[g], float(qs[k]), sizes[g], *map(float, near[g][0][k])) for g in sorted(near) for k in range(len(qs))]
    return spark.createDataFrame(out, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "q double", "n long", "b0 double", *(f"`b_{x}` double" for x in xs)]))
