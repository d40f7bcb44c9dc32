"""Statistics against numpy and plain Python on random, tied and missing inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu
from cohortlake.functions import scalar as sc
from cohortlake.operators import distributions as ds


def cases():
    rng = np.random.default_rng(0)
    yield "random", rng.normal(size=57).tolist()
    yield "tied", rng.integers(0, 5, 40).astype(float).tolist()
    yield "missing", [None if i % 4 == 0 else float(i % 7) for i in range(33)]
    yield "one", [3.0]
    yield "two", [1.0, 2.0]
    yield "constant", [2.0] * 6


def by_hand(values, p, rule):
    v = sorted(x for x in values if x is not None)
    n = len(v)
    place = round(n * p / 100, 9)
    if rule == "averaged":
        low = max(int(np.ceil(place)), 1)
        high = max(min(int(place) + 1, n), 1) if place == int(place) else low
        return (v[low - 1] + v[high - 1]) / 2
    if rule == "floor":
        return v[min(n, int(np.floor(place)) + 1) - 1]
    if rule == "inverted":
        return v[max(1, int(np.ceil(place))) - 1]
    if rule == "linear":
        return float(np.percentile(v, p))
    h = min(max((n + 1) * p / 100, 1), n)
    k = int(np.floor(round(h, 9)))
    return v[k - 1] + (h - k) * ((v[k] if k < n else v[k - 1]) - v[k - 1])


@pytest.mark.parametrize("rule", qu.RULES)
@pytest.mark.parametrize("most", [1000, 3])
def test_percentile_rules(spark, rule, most):
    rows = [(name, x) for name, values in cases() for x in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {r["g"]: r for r in qu.group_percentiles(df, ["g"], "v", (1, 10, 25, 50, 62.5, 90, 99), rule, most).collect()}
    for name, values in cases():
        for p in (1, 10, 25, 50, 62.5, 90, 99):
            assert found[name][qu.name_of(p)] == pytest.approx(by_hand(values, p, rule), abs=1e-9), (name, p)


def test_ranks_in_parts_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 30, 500))]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    one = {r.id: (r._k, r._n) for r in qu.ranked(df, [], ["v", "id"]).collect()}
    many = {r.id: (r._k, r._n) for r in qu.ranked(df, [], ["v", "id"], most=70).collect()}
    assert one == many == {i: (k + 1, 500) for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def odd_groups():
    """Null keys, groups without values, mass points, ties and one-row groups."""
    rng = np.random.default_rng(4)
    rows = [(None, "a", float(x)) for x in rng.integers(0, 4, 60)] + [(1, None, float(x)) for x in rng.normal(size=41)] + [(None, None, x) for x in (3.0, None, 1.0)]
    rows += [(2, "b", None)] * 5 + [(3, "c", 0.0)] * 80 + [(3, "c", float(x)) for x in range(20)] + [(4, "d", 7.0)]
    return rows


def values_of(rows):
    out = {}
    for a, b, v in rows:
        out.setdefault((a, b), []).append(v)
    return out


@pytest.mark.parametrize("most", [1000, 7, 1])
def test_selection_with_odd_groups(spark, most):
    df = spark.createDataFrame(odd_groups(), "a int, b string, v double").repartition(3)
    groups = values_of(odd_groups())
    for rule in ("averaged", "linear"):
        found = {(r.a, r.b): r for r in qu.group_percentiles(df, ["a", "b"], "v", (1, 25, 50, 90), rule, most).collect()}
        assert set(found) == set(groups)
        for k, v in groups.items():
            for p in (1, 25, 50, 90):
                want = by_hand(v, p, rule) if any(x is not None for x in v) else None
                assert found[k][qu.name_of(p)] == (pytest.approx(want) if want is not None else None), (k, p, rule)
    sizes = {(r.a, r.b): r["size"] for r in qu.group_percentiles(df, ["a", "b"], "v", (50,), "floor", most, [F.count("v").alias("size")]).collect()}
    assert sizes == {k: sum(x is not None for x in v) for k, v in groups.items()}


@pytest.mark.parametrize("most", [1000, 7, 1])
def test_bins_and_ranks_with_odd_groups(spark, most):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(odd_groups())], "id long, a int, b string, v double").repartition(3)
    ranks = sorted(((r.a, r.b, r._n, r._k) for r in qu.ranked(df, ["a", "b"], ["v"], most).collect()), key=str)
    assert ranks == sorted(((a, b, len(v), k + 1) for (a, b), v in values_of(odd_groups()).items() for k in range(len(v))), key=str)
    ordered = {r.id: r._k for r in qu.ranked(df, ["a", "b"], ["v", "id"], most).collect()}
    key = lambda r: (r[1][2] is not None, r[1][2] or 0, r[0])
    for g in values_of(odd_groups()):
        own = sorted((x for x in enumerate(odd_groups()) if x[1][:2] == g), key=key)
        assert [ordered[i] for i, _ in own] == list(range(1, len(own) + 1))
    bins = {r.id: r.bin for r in qu.xtile(df, ["a", "b"], "v", 4, most=most).collect()}
    share = {r.id: r.pct for r in qu.percent_rank(df, ["a", "b"], "v", most=most).collect()}
    assert len(bins) == len(share) == len(odd_groups())
    for i, (a, b, v) in enumerate(odd_groups()):
        own = [x for x in values_of(odd_groups())[a, b] if x is not None]
        if v is None:
            assert bins[i] is None and share[i] is None
        else:
            assert bins[i] == 1 + sum(v > by_hand(own, p, "averaged") for p in (25, 50, 75))
            assert share[i] == pytest.approx((sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2) / len(own))


@pytest.mark.parametrize("most", [1000, 5])
def test_text_can_be_ranked(spark, most):
    words = ["pear", "fig", None, "apple", "fig", "kiwi", "plum", "lime", "date", "fig"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, id long").repartition(4)
    got = [r.w for r in qu.ranked(df, [], ["w", "id"], most).orderBy("_k").collect()]
    assert got == sorted(words, key=lambda w: (w is not None, w or ""))


@pytest.mark.parametrize("most", [1000, 4])
def test_tied_top_shares(spark, most):
    v = [1.0] * 15 + [2.0] * 4 + [10.0]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(3)
    found = qu.top_shares(df, [], "v", (50, 80, 90), most).first()
    for p in (50, 80, 90):
        assert found[f"top{p}"] == pytest.approx(sum(sorted(v)[int(len(v) * p / 100) :]) / sum(v))
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    assert qu.smoothed_percentiles(df, [], "v", (1, 50, 99), 5, most).first() == pytest.approx((np.mean(range(1, 8)), np.mean(range(46, 57)), np.mean(range(95, 101))))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 333])
def test_rank_bins_may_share_edges(spark, n):
    edges = (1, 2, 11, 51, 91, 100, 101)
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, v double")
    at = [n * (e - 1) // 100 for e in edges]
    want = [(j, i) for j, (a, b) in enumerate(zip(at, at[1:]), 1) if min(b, n - 1) > a for i in range(a, min(b, n - 1) + 1)]
    assert sorted((r.bin, r.id) for r in qu.rank_bins(df, [], ["v", "id"], edges, shared=True).collect()) == want


def moments_by_hand(values, convention):
    x = np.array([v for v in values if v is not None])
    n, d = len(x), np.array([v for v in values if v is not None]) - np.mean([v for v in values if v is not None])
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    if convention == "sampled":
        s = np.sqrt(m2 * n / (n - 1))
        return s, m3 / s**3, m4 / s**4
    skew = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    excess = ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return {"raw": (np.sqrt(m2 * n / (n - 1)), m3 / m2**1.5, m4 / m2**2), "population": (np.sqrt(m2), m3 / m2**1.5, m4 / m2**2), "unbiased": (np.sqrt(m2 * n / (n - 1)), skew, excess), "arc": (np.sqrt(m2 * n / (n - 1)), skew, excess + 3)}[convention]


@pytest.mark.parametrize("convention", list(mo.CONVENTIONS))
def test_moment_conventions(spark, convention):
    df = spark.createDataFrame([(n, x) for n, values in cases() for x in values], "g string, v double")
    found = {r["g"]: r for r in mo.group_stats(df, ["g"], "v", convention).collect()}
    for name, values in list(cases())[:3]:
        r = found[name]
        assert (r.sd, r.skew, r.kurt) == pytest.approx(moments_by_hand(values, convention))
    if convention == "unbiased":
        assert (found["one"].sd, found["one"].skew, found["one"].kurt) == (0, 0, 0)
    if convention == "arc":
        assert found["two"].sd is None


def test_total_row(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g int, v double")
    assert {(r.g, r.n, r["mean"]) for r in mo.group_stats(df, ["g"], "v", total=True).collect()} == {(1, 2, 2.0), (2, 1, 5.0), (None, 3, 3.0)}


def test_xtile_keeps_ties_together(spark):
    df = spark.createDataFrame([(x,) for x in [1.0] * 7 + [2.0] * 2 + [3.0] + [None] * 2], "v double")
    found = {(r.v, r.bin) for r in qu.xtile(df, [], "v", 4).collect()}
    assert len({v for v, _ in found}) == len(found) and (None, None) in found


@pytest.mark.parametrize("n", [0, 1, 7, 100, 333])
def test_rank_bins_are_disjoint_and_whole(spark, n):
    edges = (1, 2, 11, 51, 91, 100, 101)
    df = spark.createDataFrame([(i, float(i * 7 % 13)) for i in range(n)], "id long, v double")
    found = sorted((r.v, r.id, r.bin) for r in qu.rank_bins(df, [], ["v", "id"], edges).collect())
    at = [int(np.floor(n * (e - 1) / 100)) for e in edges]
    assert [b for _, _, b in found] == [next(j for j in range(1, len(edges)) if k < at[j] or j == len(edges) - 1) for k in range(n)]


def test_smoothed_and_shares(spark):
    v = list(range(1, 101))
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    assert qu.smoothed_percentiles(df, ["g"], "v", (50,)).first().p50 == pytest.approx(np.mean(v[45:56]))
    assert qu.top_shares(df, ["g"], "v", (90,)).first().top90 == pytest.approx(sum(v[90:]) / sum(v))


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 2.0)], "a double, b double")
    got = df.select(sc.arc_change(F.col("b"), F.col("a")).alias("g"), sc.row_total(["a", "b"]).alias("t"), sc.row_sum(["a", "b"]).alias("s"), sc.logistic(F.col("a") * 1e6).alias("l")).collect()
    assert [r.g for r in got] == [1.0, None, None] and [r.t for r in got] == [4.0, 0.0, 2.0] and [r.s for r in got] == [4.0, 0.0, None]
    assert got[0].l == pytest.approx(1.0)
    sig = spark.createDataFrame([(123456.0,), (0.0012345,), (0.0,), (-98765.0,)], "x double").select(sc.significant(F.col("x"), 3).alias("y")).collect()
    assert [r.y for r in sig] == pytest.approx([123000.0, 0.00123, 0.0, -98800.0])
    u = spark.range(2000).select(sc.uniform("s", F.col("id")).alias("u"), sc.md5_uniform("s", F.col("id")).alias("m")).agg(F.avg("u"), F.avg("m"), F.min("u"), F.max("m")).first()
    assert abs(u[0] - 0.5) < 0.03 and abs(u[1] - 0.5) < 0.03 and u[2] >= 0 and u[3] < 1


def test_distributions(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(1000)], "v double")
    h = ds.histogram(df, "v", 10, 1.0)
    assert h.agg(F.sum("n")).first()[0] == 1000 and abs(h.agg(F.sum("share")).first()[0] - 1) < 1e-9
    k = ds.kernel_density(df, "v", points=200).orderBy("at").collect()
    assert sum((a.density + b.density) / 2 * (b["at"] - a["at"]) for a, b in zip(k, k[1:])) == pytest.approx(1, abs=0.02)
    assert ds.distinct_counts(spark.createDataFrame([(1, None), (1, 2), (None, 2)], "a int, b int"), ["a", "b"], "both").first() == (1, 1, 1)
    assert [r.pct for r in ds.empirical_cdf(spark.createDataFrame([(0,), (2,)], "e int"), "e", 3).orderBy("i").collect()] == [50.0, 50.0, 100.0, 100.0]
