"""Simulation, moments, objective and search against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import reshape as rs
from cohortlake.plans import objective as ob
from cohortlake.plans import panel_moments as pm
from cohortlake.plans import search as se
from cohortlake.plans import simulation as si


@pytest.fixture(scope="module")
def panel(spark):
    return si.simulated(si.shock_rows(spark, 600).repartition(4)).persist()


def test_fold_equals_the_kernel(panel):
    y = si.simulate(si.TRUTH, si.shocks(600))
    found = np.array([r.y for r in panel.orderBy("id").collect()])
    assert np.allclose(found, y, rtol=1e-9, atol=1e-9)


def test_shock_order_is_one_stream():
    rng = np.random.default_rng(42)
    s = si.shocks(50)
    assert np.array_equal(s["hip1"], rng.standard_normal(50)) and np.array_equal(s["hip2"], rng.standard_normal(50)) and np.array_equal(s["z0"], rng.standard_normal(50))
    for h in range(2):
        assert np.array_equal(s["p_ar"][h], rng.uniform(size=50)) and np.array_equal(s["eta"][h], rng.standard_normal(50)) and np.array_equal(s["unemp"][h], rng.uniform(size=50))
        assert np.array_equal(s["nu"][h], rng.uniform(size=50)) and np.array_equal(s["p_eps"][h], rng.uniform(size=50)) and np.array_equal(s["eps"][h], rng.standard_normal(50))


@pytest.mark.parametrize("shared", [False, True])
def test_spark_moments_equal_numpy(panel, shared):
    tensors = pm.moment_vector(si.simulate(si.TRUTH, si.shocks(600)), shared=shared)
    assert {k: v.shape for k, v in tensors.items()} == {"ssk_l1": (3, 13, 3), "ssk_l5": (3, 13, 3), "ir": (2, 8, 10, 6), "incgrowth": (15, 8), "var_lny": (36,), "emp_cdf": (37,)}
    for r in pm.all_moments(panel, shared=shared).collect():
        at = (r.i, r.j, r.k, r.l)[: tensors[r.grp].ndim]
        assert r.value == pytest.approx(tensors[r.grp][at], rel=1e-6, abs=1e-7), (r.grp, at)


def test_objective_plan_equals_the_function(spark, panel):
    problem = ob.Problem.synthetic(["a1", "rho1"], 600)
    assert problem(si.TRUTH[[1, 6]]) == pytest.approx(0, abs=1e-20)
    moved = si.simulated(si.shock_rows(spark, 600), {k: v[0] for k, v in si.PARAMETERS.items()} | {"a1": 0.9})
    targets = ob.weighted_targets(full(spark, pm.all_moments(panel)))
    q = ob.objective_value(full(spark, pm.all_moments(moved)), targets).first().q
    assert q == pytest.approx(problem([0.9, si.TRUTH[6]]), rel=1e-5)


def full(spark, moments):
    """Every cell of the tensors, zero where a bin is empty, as the vector has it."""
    shapes = {"ssk_l1": (3, 13, 3), "ssk_l5": (3, 13, 3), "ir": (2, 8, 10, 6), "incgrowth": (15, 8), "var_lny": (36,), "emp_cdf": (37,)}
    rows = [(g, *(list(map(int, c)) + [0] * (4 - len(s)))) for g, s in shapes.items() for c in np.ndindex(*s)]
    grid = spark.createDataFrame(rows, "grp string, i long, j long, k long, l long")
    return grid.join(moments, ["grp", "i", "j", "k", "l"], "left").na.fill(0.0, ["value"])


def test_flat_vector(panel):
    flat = rs.flattened(pm.all_moments(panel), order=["ssk_l1", "ssk_l5", "ir", "incgrowth", "var_lny", "emp_cdf"])
    places = sorted(r.pos for r in flat.select("pos").collect())
    assert places == list(range(len(places)))
    ranges = sorted((r["first"], r["end"]) for r in rs.slices(flat).collect())
    assert ranges[0][0] == 0 and ranges[-1][1] == len(places) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_sobol_points(spark):
    unit = np.array([[0.0, 1.0]] * 21)
    x = np.array([r.x for r in se.sobol_points(spark, 8, unit, seed=None).orderBy("i").collect()])
    assert x[:, 0].tolist() == [0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125, 0.1875] and x[:3, 1].tolist() == [0.5, 0.25, 0.75]
    many = np.array([r.x for r in se.sobol_points(spark, 1024, unit, seed=None, skip=0).collect()])
    for d in range(21):
        assert sorted((many[:, d] * 1024).astype(int)) == list(range(1024))  # one point in each of 1024 cells
    shifted = np.array([r.x for r in se.sobol_points(spark, 64, si.BOUNDS).collect()])
    assert (shifted >= si.BOUNDS[:, 0]).all() and (shifted <= si.BOUNDS[:, 1]).all()


def test_starts_and_minimum(spark):
    rows = [(0, [0.1], 5.0), (1, [0.3], 2.0), (2, [0.2], 9.0), (3, [0.4], float("nan")), (4, [0.5], float("inf")), (5, [0.6], 1e9), (6, [0.7], 2.0)]
    screened = spark.createDataFrame(rows, "i long, x array<double>, f double")
    assert [r.i for r in se.starts(screened, 3).collect()] == [1, 6, 0]
    assert [r.i for r in se.starts(screened, 3, distinct=True).collect()] == [1, 0, 2]


@pytest.mark.parametrize("method", [se.nelder_mead, se.powell, se.local_search])
def test_local_searches(method):
    bounds = np.array([[-2.0, 2.0], [-2.0, 2.0]])
    x, f = method(lambda v: float((v[0] - 0.5) ** 2 + 3 * (v[1] + 0.25) ** 2 + 0.5 * v[0] * v[1]), np.array([1.5, 1.5]), bounds, 300)
    grid = min((a - 0.5) ** 2 + 3 * (b + 0.25) ** 2 + 0.5 * a * b for a in np.linspace(-2, 2, 201) for b in np.linspace(-2, 2, 201))
    assert f <= grid + 1e-3
    x, _ = method(lambda v: float(((v - 5) ** 2).sum()), np.array([0.0, 0.0]), bounds, 200)
    assert np.allclose(x, 2, atol=1e-2)


def test_failures_cost_the_failure_value(spark):
    def bad(x):
        raise ValueError("no")

    assert [r.f for r in ob.evaluated(spark.createDataFrame([(0, [1.0])], "i long, x array<double>"), bad).collect()] == [ob.FAILED]
    with pytest.raises(ValueError):
        ob.Problem(["unknown"], {"a": np.zeros(2)}, 10)


def test_recovery(spark):
    problem = ob.Problem.synthetic(["a1", "rho1"], 300)
    found = se.minimise(spark, problem, problem.bounds, draws=64, keep=4, maxiter=60, batch=4)
    truth = si.TRUTH[[1, 6]]
    assert abs(found["x"][0] - truth[0]) < 0.05 and abs(found["x"][1] - truth[1]) < 0.02 and found["f"] < 1e-2
    assert len(found["local"]) == 4
    report = se.recovery(spark, problem.free, found["x"], truth).agg(F.max(F.abs("error"))).first()[0]
    assert report < 0.05
