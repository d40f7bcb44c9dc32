"""Queries on tables that hold what only larger ones do, against their SQL."""

import math

import duckdb
import numpy as np

from cohortlake.functions import quantiles as qu
from cohortlake.operators import regression as rg
from cohortlake.queries import oracle_sql, queries
from cohortlake.sources import readers


def against_sql(spark, name, folder, **tables):
    """Rows of a query on the tables and those of its SQL, columns by name."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = queries()[name](spark, str(folder))
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    order = sorted(names)
    return sorted(tuple(r[c] for c in order) for r in df.collect()), sorted(tuple(r[names.index(c)] for c in order) for r in found.fetchall())


def test_bootstrap_counts_as_far_as_its_sql(spark, data, tmp_path):
    # the digests of these persons ask for nine copies and more
    orders = readers.table(spark, data, "orders").limit(3)
    orders = orders.drop("o_custkey").crossJoin(spark.createDataFrame([(331918,), (3652812,), (5,)], "o_custkey long"))
    ours, theirs = against_sql(spark, "e08_bootstrap", tmp_path, orders=orders)
    assert ours == theirs
    cuts = rg.poisson_cuts()
    assert rg.poisson_cuts(8) == cuts[:8] and cuts[-1] > 1 - 2.0**-48 >= cuts[-2]
    assert all(math.isclose(b - a, math.exp(-1) / math.factorial(k), rel_tol=1e-2) for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1) if k < 11)


def test_legitimate_keeps_the_first_key(spark, tmp_path):
    orders = spark.createDataFrame([(0, 5.0), (-3, 7.0), (1, 8.0), (2, 100000.0), (3, None), (4, float("nan"))], "o_orderkey long, o_totalprice double")
    ours, theirs = against_sql(spark, "f13_legitimate", tmp_path, orders=orders)
    assert ours == theirs and len(ours) == 3


def test_matrix_is_read_in_three_splits_whatever_the_cores(spark, data, tmp_path):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")  # what a file much larger than this cost meets
    try:
        ours, theirs = against_sql(spark, "s03_matrix_shape", tmp_path, orders=readers.table(spark, data, "orders"))
        assert spark.conf.get("spark.sql.files.openCostInBytes") == "16"
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert ours == theirs


def test_large_groups_are_selected_from_counted_values(spark, monkeypatch):
    held = {}

    def noted(df, label, own=qu.staged):
        out = own(df, label)
        held[label] = out.count()
        return out

    monkeypatch.setattr(qu, "staged", noted)
    rows = [(g, float(i * i % 7)) for g in ("a", None) for i in range(500)] + [("b", float(i)) for i in range(333)] + [("b", None), ("none", None), ("one", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in qu.group_percentiles(df, ["g"], "v", (1, 25, 50, 75, 99), "linear", most=40).collect()}
    assert held["ranged"] == 2 * 4 + 333 + 1  # squares have four remainders by 7
    for g in ("a", None, "b", "one"):
        want = np.percentile([v for k, v in rows if k == g and v is not None], (1, 25, 50, 75, 99))
        assert np.allclose(want, got[g][1:]), g
    assert got["none"].p50 is None and len(got) == 5


def test_cut_points_are_sent_to_the_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i % 2, float(i % 50)) for i in range(600)], "g int, v double")
        for most in (50, 1000):
            binned = qu.xtile(df, ["g"], "v", 10, most=most)
            plan = binned._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # two groups do not make two tasks
            assert sorted({r.bin for r in binned.collect()}) == list(range(1, 11))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_find_their_group_by_bisection(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.1, *[float(i * i % 97) for i in range(150)], *[7.0] * 60]
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values] + [("none", None)], "g string, v double")
    for groups in (2, 3, 8, 23, 100):
        cuts = {r.g: r.cuts for r in qu.cut_points(df, ["g"], "v", groups).collect()}
        binned = qu.xtile(df, ["g"], "v", groups)
        assert "lambda" not in binned._jdf.queryExecution().executedPlan().toString()  # one comparison for each cut point before
        top = lambda x: (math.isnan(x), x)  # noqa: E731  NaN is the largest value
        for r in binned.collect():
            assert r.bin == (None if r.v is None else 1 + sum(top(r.v) > top(c) for c in cuts[r.g])), (groups, r)


def test_edges_are_compared_in_compiled_code(spark):
    from cohortlake.plans import pipelines as pl

    df = spark.createDataFrame([(None,), (1.0,), (5.0,), (5.5,), (95.0,), (100.0,)], "fine double")
    out = df.select("fine", pl.edge_group(df.fine, pl.INCOME_EDGES).alias("edge"))
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.edge for r in out.collect()] == [1, 1, 1, 2, 7, 8]


def test_stayers_read_the_line_items_once(spark, data, monkeypatch):
    from cohortlake.plans import growth as gr

    reading = []

    def noted(df, label, own=qu.staged):
        reading.extend([label] if any("lineitem" in f for f in df.inputFiles()) else [])
        return own(df, label)

    for module in (qu, gr):
        monkeypatch.setattr(module, "staged", noted)
    assert queries()["m18_stayers"](spark, data).count()
    assert not reading  # the query stages the jobs; profile, panel and pairs read that


def test_toolbox_impulse_stages_what_it_needs(spark, data, tmp_path, monkeypatch):
    held = {}
    monkeypatch.setattr(qu, "staged", lambda df, label, own=qu.staged: held.setdefault(label, set()).update(df.columns) or own(df, label))
    ours, theirs = against_sql(spark, "m13_toolbox_impulse", tmp_path, orders=readers.table(spark, data, "orders"))
    assert ours == theirs
    assert held["xtile"] == {"age_group", "re", "past", "next1", "next2", "inc"}
