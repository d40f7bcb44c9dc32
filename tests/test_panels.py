"""Panel, filter, join and reshape operators on small panels with gaps, ties, missing values and edges."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import filters as fl
from cohortlake.operators import joins as jn
from cohortlake.operators import panel as pn
from cohortlake.operators import quantile_regression as qr
from cohortlake.operators import regression as rg
from cohortlake.operators import reshape as rs

ROWS = [(1, 2000, 10.0), (1, 2001, 20.0), (1, 2003, 40.0), (2, 2000, 5.0), (2, 2001, None), (3, 2005, 7.0)]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(ROWS, "id long, yr long, y double")


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_calendar_shift_respects_gaps(panel):
    found = {(r.id, r.yr): r.y_n for r in pn.calendar_shift(panel, ["y"], 1, "_n").collect()}
    assert found == {(1, 2000): 20.0, (1, 2001): None, (1, 2003): None, (2, 2000): None, (2, 2001): None, (3, 2005): None}
    joined = {(r.id, r.yr): r.y_n for r in pn.calendar_self_join(panel, ["y"], 1, "_n").collect()}
    assert joined == found


def test_fill_and_recent(panel):
    assert {(r.id, r.yr): r.f for r in pn.filled(panel, "y", "f").collect()}[2, 2001] == 5.0
    recent = {(r.id, r.yr): (r.nv, r.re) for r in pn.recent_income(panel, "y", 8.0, 5, 2).collect()}
    assert recent[1, 2001] == (2, 15.0) and recent[1, 2003] == (3, pytest.approx(70 / 3)) and recent[1, 2000] == (1, None) and recent[2, 2000] == (0, None)


def test_stayers(spark):
    jobs = pn.employers(spark.createDataFrame([(1, t, e, a) for t, e, a in [(1, 7, 10.0), (1, 8, 5.0), (2, 8, 9.0), (2, 7, 1.0), (3, 8, 4.0), (4, 9, 1.0)]], "id long, yr long, ein long, amount double"))
    of = lambda m: {r.yr: r.stayer for r in pn.stayers(jobs, m).collect()}
    assert of("any") == {1: None, 2: 1, 3: 0, 4: None} and of("strict") == {1: None, 2: 0, 3: 0, 4: None}


def test_transitions_and_spells(spark):
    p = spark.createDataFrame([(1, t, e) for t, e in [(1, 0), (2, 1), (3, 0), (5, 1)]], "id long, yr long, e int")
    assert {r.yr: (r.entry, r.exit) for r in pn.transitions(p, "e").collect()} == {1: (None, None), 2: (1, 0), 3: (0, 1), 5: (None, None)}
    assert {r.yr: r.c for r in pn.spells_cleaned(p, "e", "c").collect()} == {1: 0, 2: 0, 3: 1, 5: 1}


def test_sample_rules(spark, panel):
    assert fl.employed_at_least(panel, 2, 8.0).select("id").distinct().collect() == [(1,)]
    assert values(fl.recently_attached(panel, 8.0, 5, 3), "id", "yr") == [(1, 2003)]
    assert values(fl.without_gaps(panel, 2), "id", "yr") == [(1, 2000), (1, 2001), (1, 2003), (2, 2000), (2, 2001)]
    assert values(fl.without_bad(panel, F.col("y") < 6), "id", "yr") == [(1, 2000), (1, 2001), (1, 2003), (3, 2005)]
    edges = spark.createDataFrame([(1975, None), (1975, 2003), (1940, None), (1990, None)], "b int, d int")
    years = [r[0] for r in edges.select(fl.observable_years(F.col("b"), F.col("d"), 1995, 2005)).collect()]
    assert years == [7, 4, 5, 0]
    assert [r[0] for r in edges.select(fl.alive(F.lit(2003), F.col("d"))).collect()] == [True, False, True, True]
    f = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (1e9,)], "f double")
    assert f.filter(fl.legitimate(F.col("f"))).count() == 1


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, b string")
    assert values(jn.full_merge(a, b, ["k"]), "k", "merge") == [(1, 1), (2, 3), (3, 2)]
    assert values(jn.merge_keep(a, b, ["k"]), "k", "merge") == [(1, 1), (2, 3)]
    assert values(jn.merge_keep(a, b, ["k"], (3,)), "k") == [(2,)]
    assert values(jn.merge_keep(a, b, ["k"], (2,)), "k") == [(3,)]
    assert values(jn.replaced(a, spark.createDataFrame([(2, "n")], "k int, a string"), ["k"]), "k", "a") == [(1, "x"), (2, "n")]


def test_lookups(spark):
    x = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (3.0,), (9.0,), (None,)], "x double")
    knots = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (4.0, 40.0)], "x double, y double")
    assert [r.v for r in jn.interpolated(x, "x", knots, "v").collect()] == [0.0, 0.0, 5.0, 10.0, 30.0, 40.0, None]
    assert [r.m for r in jn.nearest(x, "x", spark.createDataFrame([(0.0,), (1.0,)], "m double"), "m", "m").collect()][:4] == [0.0, 0.0, 0.0, 1.0]
    spans = spark.createDataFrame([(0.0, 1.0, "a"), (1.0, 50.0, "b")], "lo double, hi double, n string")
    assert values(jn.range_joined(x, "x", spans, "lo", "hi", 10.0), "x", "n") == [(0.0, "a"), (0.5, "a"), (1.0, "b"), (3.0, "b"), (9.0, "b")]
    assert jn.bracketed_knots(knots, "x", "y").count() == 2


def test_reshapes(spark, panel):
    wide = rs.long_to_wide(panel, ["id"], "y", [2000, 2001, 2003, 2005])
    back = rs.wide_to_long(wide, ["id"], ["y"], [2000, 2001, 2003, 2005])
    assert values(back, "id", "yr", "y") == sorted(((a, b, c) for a, b, c in ROWS if c is not None), key=str)
    assert rs.dense_ages(panel.withColumn("age", F.col("yr") - 1999), 1, 4).orderBy("id").first().y == [10.0, 20.0, 0.0, 40.0]
    ramp = spark.createDataFrame([([10.0, 20.0],)], "y array<double>").select(rs.extended(F.col("y"), 2, 1).alias("y")).first().y
    assert ramp == pytest.approx([1.0, 5.5, 10.0, 20.0, 20.2])


def test_regressions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(2 * a - b + rng.normal())) for a, b in rng.integers(0, 4, (200, 2))]
    df = spark.createDataFrame(rows, "a long, b long, y double")
    x = np.zeros((200, 7))
    for i, (a, b, _) in enumerate(rows):
        x[i, a] = 1
        if b:
            x[i, 3 + b] = 1
    expected = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    found = {(r.factor, r.level): r.coef for r in rg.dummy_least_squares(df, "y", "a", "b").collect()}
    assert [found["a", k] for k in range(4)] + [found["b", k] for k in range(1, 4)] == pytest.approx(expected.tolist())
    resid = rg.residuals_by_group(df.withColumn("one", F.lit(1)), "one", "y", ["a", "b"]).collect()
    assert sum(r.resid**2 for r in resid) == pytest.approx(float(((np.array([r[2] for r in rows]) - x @ expected) ** 2).sum()))
    poly = rg.polynomial_by_group(df.withColumn("one", F.lit(1)), ["one"], "a", "y", 2).first()
    assert [poly.b2, poly.b1, poly.b0] == pytest.approx(np.polyfit([r[0] for r in rows], [r[2] for r in rows], 2).tolist())
    line = spark.createDataFrame([(float(i), 3.0 + 2.0 * i) for i in range(30)], "x double, y double").withColumn("one", F.lit(1))
    q = qr.quantile_regressions(line, ["one"], "y", ["x"], [0.5]).first()
    assert (q.b0, q.b_x) == pytest.approx((3.0, 2.0), abs=1e-9)
    assert [r.smooth for r in rg.loess(line, ["one"], "x", "y").orderBy("x").collect()] == pytest.approx([3 + 2 * i for i in range(30)])


def check_loss(rows, b, q):
    r = np.array([y - b[0] - sum(c * x for c, x in zip(b[1:], xs, strict=True)) for y, *xs in rows])
    return float(np.maximum(q * r, (q - 1) * r).sum())


def least_loss(rows, q):
    """Some best fit goes through as many rows as there are coefficients."""
    p, best = len(rows[0]), math.inf
    for own in itertools.combinations(rows, p):
        x = np.array([[1.0, *xs] for _, *xs in own])
        if np.linalg.matrix_rank(x) == p:
            best = min(best, check_loss(rows, np.linalg.solve(x, np.array([y for y, *_ in own])), q))
    return best


@pytest.mark.parametrize("band", [4000, 12])
def test_quantile_regressions_are_exact(spark, band):
    """Against every fit through rows; a small band takes the way of large groups. Null keys, repeated rows, ties and missing values."""
    rng = np.random.default_rng(8)
    groups = {"a": [(float(y), float(x)) for x, y in zip(rng.normal(size=90), rng.standard_t(3, 90), strict=True)], None: [(float(round(2 * x + e)), float(round(x))) for x, e in rng.normal(size=(70, 2)) * 2], "one": [(5.0, 1.0)] * 3}
    rows = [(g, y, x) for g, own in groups.items() for y, x in own] + [("a", None, 1.0), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, y double, x double").repartition(4)
    found = qr.quantile_regressions(df, ["g"], "y", ["x"], [0.1, 0.5, 0.8], band).collect()
    assert len(found) == 9
    for r in found:
        own = groups[r.g]
        assert r.n == len(own)
        want = least_loss(own, r.q) if r.g != "one" else 0.0
        assert check_loss(own, (r.b0, r.b_x), r.q) == pytest.approx(want, abs=1e-7), (r.g, r.q)
    assert qr.quantile_regressions(df.filter("false"), ["g"], "y", ["x"], [0.5], band).count() == 0


def test_large_groups_take_few_rows_to_one_task(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 2))
    y = 1 + x @ [2.0, -1.0] + rng.standard_t(4, 6000) * (1 + 0.3 * np.abs(x[:, 0]))
    df = spark.createDataFrame([(float(v), float(a), float(b)) for v, (a, b) in zip(y, x, strict=True)], "y double, u double, v double").repartition(5)
    found = qr.quantile_regressions(df, [], "y", ["u", "v"], [0.25, 0.9], band=300).collect()
    design = np.column_stack([np.ones(6000), x])
    for r in found:
        whole = qr.exact_fit(design, y, np.ones(6000), r.q, np.array([r.b0, r.b_u, r.b_v]), np.zeros(3))
        assert (r.b0, r.b_u, r.b_v) == pytest.approx(whole.tolist(), abs=1e-9)


def test_replicates_draw_exactly_n(spark):
    df = spark.createDataFrame([(i * 7, t) for i in range(211) for t in range(2)], "id long, yr long").repartition(3)
    weights = [r.w for r in rg.replicate_weights(df, 4).collect()]
    assert len(weights) == 211 and [sum(w) for w in zip(*weights, strict=True)] == [211] * 4
    assert len({tuple(w) for w in zip(*weights, strict=True)}) == 4 and 0.25 < sum(w[0] == 0 for w in weights) / 211 < 0.5


def test_bootstrap_draws_persons_whole(spark):
    df = spark.createDataFrame([(i, t) for i in range(300) for t in range(2)], "id long, yr long")
    drawn = rg.bootstrap(df, 3).groupBy("rep", "id", "yr").count().collect()
    times = {}
    for r in drawn:
        assert times.setdefault((r.rep, r.id), r["count"]) == r["count"]
    assert math.isclose(sum(times.values()) / 900, 1, abs_tol=0.15)
