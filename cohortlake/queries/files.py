"""Sources and sinks, each written below a scratch folder and read back, and column features without a table of their own."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlake.functions import linear as li
from cohortlake.functions import scalar as sc
from cohortlake.operators import columns as co
from cohortlake.operators import joins as jn
from cohortlake.operators import panel as pn
from cohortlake.queries.registry import FLOOR, aged, big, panel, query, rounded
from cohortlake.session import shared_folder
from cohortlake.sources import readers, sinks

NATION = "n_nationkey int, n_name string, n_regionkey int"


def _scratch(spark, name: str) -> str:
    """A new path below the session's shared folder, removed when the process ends."""
    return shared_folder(spark, name)


def _local(path: str) -> str:
    """The driver's name of a path, for small files that the driver writes; its folder exists."""
    own = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(own), exist_ok=True)
    return own


def _nation(spark, d):
    return readers.table(spark, d, "nation")


# --- sources and sinks


@query("select n_nationkey, n_name, n_regionkey from nation")
def s01_table(spark, d):
    return _nation(spark, d)


def _matrix_file(spark, d, name):
    lines = _nation(spark, d).select("n_nationkey", F.concat_ws(" \t ", F.col("n_regionkey").cast("string"), (F.col("n_nationkey") / 4).cast("string")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path := _scratch(spark, name))
    return path


@query("select n_nationkey::bigint as i, 0::bigint as j, n_regionkey::double as value from nation union all select n_nationkey, 1, n_nationkey / 4.0 from nation")
def s03_matrix(spark, d):
    return readers.matrix(spark, _matrix_file(spark, d, "matrix"))


@query("select count(*) as rows, 2::bigint as least, 2::bigint as most, 0::bigint as bad, 3::bigint as splits from orders")
def s03_matrix_shape(spark, d):
    """A matrix of all orders in one file, read in several splits: its rows, columns and cells that are no numbers."""
    lines = readers.table(spark, d, "orders").select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")).alias("value"))
    lines.coalesce(1).write.text(path := _scratch(spark, "orders-matrix"))
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    # a split has the first of these, but where the session has more cores than the file has thirds, no less than the second
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(-(-size // 3)))
    try:
        shape = readers.matrix_shape(spark, path).drop("file")
        splits = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return shape.withColumn("splits", F.lit(splits).cast("long"))


@query("select (n_nationkey // 5)::bigint as a, (n_nationkey % 5)::bigint as b, j::bigint as c, (case when j = 0 then n_regionkey else n_nationkey / 4.0 end)::double as value from nation, range(2) t(j)")
def s04_tensor(spark, d):
    return readers.tensor(readers.matrix(spark, _matrix_file(spark, d, "tensor")), (5, 5, 2), ("a", "b", "c"))


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def k02_tab_text(spark, d):
    sinks.export_text(_nation(spark, d), path := _scratch(spark, "tab"), ["n_nationkey", "n_name"], "n_regionkey = 2")
    return readers.delimited(spark, path, "n_nationkey int, n_name string", "\t")


@query("select n_nationkey, n_name, n_regionkey from nation")
def s05_delimited(spark, d):
    sinks.export_text(_nation(spark, d), path := _scratch(spark, "delimited"), sep="|")
    return readers.delimited(spark, path, NATION, "|")


@query("select n_nationkey, n_name, n_regionkey from nation")
def s06_csv(spark, d):
    sinks.export_text(_nation(spark, d), path := _scratch(spark, "csv"), sep=",", header=False)
    return readers.delimited(spark, path, NATION, ",", header=False)


@query("select c_custkey, c_nationkey, c_acctbal from customer")
def k01_save_table(spark, d):
    """Parquet by nation and back."""
    sinks.save_table(readers.table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]), path := _scratch(spark, "saved"), partition_by=["c_nationkey"])
    return spark.read.parquet(path).select("c_custkey", "c_nationkey", "c_acctbal")


@query("select c_custkey, c_acctbal from customer where c_custkey <= 100")
def s07_parquet(spark, d):
    sinks.save_table(readers.table(spark, d, "customer"), path := _scratch(spark, "parquet"))
    return spark.read.parquet(path).filter("c_custkey <= 100").select("c_custkey", "c_acctbal")


@query("select * from (values (0::bigint, 5.0::double), (1, 2.0), (2, 9.0)) t(k, f)")
def s09_json_records(spark, d):
    """Three records and one broken file, each written in one step."""
    folder = _scratch(spark, "records")
    for k, f in enumerate((5.0, 2.0, 9.0)):
        sinks.write_json_atomically({"k": k, "f": f}, _local(f"{folder}/{k}.json"))
    with open(_local(f"{folder}/broken.json"), "w") as out:
        out.write('{"k": 3, "f": ')
    return readers.json_records(spark, folder, "k long, f double")


@query("select 'second' as state, 2::bigint as step")
def k06_atomic_json(spark, d):
    """The second write replaces the first."""
    file = _scratch(spark, "state") + "/state.json"
    for step, state in enumerate(("first", "second"), 1):
        sinks.write_json_atomically({"state": state, "step": step}, _local(file))
    return readers.json_records(spark, file, "state string, step long")


@query("select r_regionkey::bigint as i, r_regionkey * 10.0::double as a, (r_regionkey * 10.0 + 1)::double as b from region")
def s10_npy(spark, d):
    file = _local(_scratch(spark, "arrays") + "/rows.npy")
    np.save(file, np.array([[10.0 * k, 10.0 * k + 1] for k in range(5)]))
    return readers.npy_rows(spark, file).select("i", F.col("y")[0].alias("a"), F.col("y")[1].alias("b"))


@query("select r_regionkey, r_name from region")
def s13_arrow(spark, d):
    rows = readers.table(spark, d, "region").select("r_regionkey", "r_name").toArrow()
    return readers.arrow_table(spark, pa.table({c: rows.column(c) for c in rows.column_names}))


@query("select n_regionkey::bigint as i, (n_nationkey % 5)::bigint as j, sum(n_nationkey)::double as value from nation group by 1, 2")
def k04_tensor_file(spark, d):
    cells = _nation(spark, d).groupBy(F.col("n_regionkey").cast("long").alias("i"), (F.col("n_nationkey") % 5).cast("long").alias("j")).agg(F.sum("n_nationkey").cast("double").alias("value"))
    sinks.export_tensor(cells, path := _scratch(spark, "cells"), ["i", "j"])
    return readers.delimited(spark, path, "i long, j long, value double")


@query("select n_nationkey::bigint as k, n_regionkey::double as f from nation where n_nationkey < 4")
def k07_append(spark, d):
    path = _scratch(spark, "results")
    rows = _nation(spark, d).select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("double").alias("f"))
    sinks.append_result(rows.filter("k < 2"), path)
    sinks.append_result(rows.filter("k in (2, 3)"), path)
    return spark.read.parquet(path)


# --- columns


@query("select id, yr, lag(y) over (partition by id order by yr) as before from p", "panel")
def w01_previous_row(spark, d):
    return pn.shifted(panel(spark, d), "y", 1, "before").select("id", "yr", "before")


@query("select k::bigint as k, round(1 / (1 + exp(-least(greatest(x, -500.0), 500.0))), 12) as p from (values (0, -1e6), (1, -2.0), (2, 0.0), (3, 3.5), (4, 1e6)) t(k, x)")
def x02_logistic(spark, d):
    rows = readers.inline(spark, [(0, -1e6), (1, -2.0), (2, 0.0), (3, 3.5), (4, 1e6)], "k long, x double")
    return rows.select("k", F.round(sc.logistic(F.col("x")), 12).alias("p"))


@query("select o_orderkey, least(greatest(o_totalprice, 60000.0), 200000.0) as inside, round(2 * power(greatest(60000.0 - o_totalprice, 0) + greatest(o_totalprice - 200000.0, 0), 2), 2) as penalty from orders")
def x03_bounds(spark, d):
    y = F.col("o_totalprice")
    return readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", sc.clip(y, 60000.0, 200000.0).alias("inside"), F.round(sc.bound_penalty(y, 60000.0, 200000.0, 2.0), 2).alias("penalty"))


@query("""with v as (select l_returnflag, var_samp(l_quantity) as aa, covar_samp(l_quantity, l_extendedprice / 1000) as ab, covar_samp(l_quantity, l_tax * 100) as ac, var_samp(l_extendedprice / 1000) as bb, covar_samp(l_extendedprice / 1000, l_tax * 100) as bc, var_samp(l_tax * 100) as cc from lineitem group by 1),
w as (select *, sqrt(aa) as l00, ab / sqrt(aa) as l10, ac / sqrt(aa) as l20 from v), x as (select *, sqrt(bb - l10 * l10) as l11 from w), z as (select *, (bc - l20 * l10) / l11 as l21 from x)
select l_returnflag, round(l00, 5) as l00, round(l10, 5) as l10, round(l11, 5) as l11, round(l20, 5) as l20, round(l21, 5) as l21, round(sqrt(cc - l20 * l20 - l21 * l21), 5) as l22, round(l00 * l10, 5) as outer01 from z""")  # fmt: skip
def x05_cholesky(spark, d):
    """The factor of a covariance matrix of three columns in each group, and one cell of an outer product."""
    rows = readers.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_tax") * 100).alias("c"))
    cells = [[F.covar_samp(x, y).alias(f"{x}{y}") for y in "abc"] for x in "abc"]
    found = rows.groupBy("l_returnflag").agg(*[c for row in cells for c in row])
    factor = li.cholesky([[F.col(f"{x}{y}") for y in "abc"] for x in "abc"])
    named = found.select("l_returnflag", *[factor[i][j].alias(f"l{i}{j}") for i in range(3) for j in range(i + 1)])
    return rounded(named.withColumn("outer01", li.outer([F.col("l00")], [F.col("l10")])[0][0]), 5)


KNOTS_SQL = "k as (select yr as x, round(avg(y) / 20000) as f from p group by yr), u as (select min(x) as x, f from k group by f), v as (select x, f, lead(x) over (order by x) as x1, lead(f) over (order by x) as f1, min(x) over () as lo, max(x) over () as hi from u)"


@query(f"with {KNOTS_SQL}, q as (select 1994 + i / 4.0 as pos from range(40) t(i)) select pos::double as pos, round(coalesce(max(case when pos >= x and (pos < x1 or x1 is null) then case when x1 is null then f else f + (pos - x) * (f1 - f) / (x1 - x) end end), min_by(f, x)), 6) as value from q, v group by pos", "panel")
def x06_monotone_interpolation(spark, d):
    """Knots with equal values after rounding give one knot, the first."""
    knots = panel(spark, d).groupBy(F.col("yr").alias("x")).agg(F.round(F.avg("y") / 20000).alias("f"))
    points = spark.range(40).select((1994 + F.col("id") / 4.0).alias("pos"))
    return rounded(jn.interpolated(points, "pos", jn.distinct_knots(knots, "x", "f"), "value", "x", "f"))


@query("select o_orderkey, year(o_orderdate)::bigint as yr, month(o_orderdate)::bigint as mon, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::bigint as quarter from orders")
def x07_dates(spark, d):
    when = F.col("o_orderdate")
    return readers.table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", big(F.year(when)).alias("yr"), big(F.month(when)).alias("mon"), big(F.year(when) * 4 + F.quarter(when) - 1).alias("quarter"))


@query("select id, yr, yr - (1940 + id % 36) + 1 as first, yr - (1940 + id % 36) as completed, 1940 + id % 36 as cohort from p", "panel")
def x09_age_conventions(spark, d):
    born = 1940 + F.col("id") % 36
    one = pn.with_age(panel(spark, d), born).withColumnRenamed("age", "first").drop("yob")
    return pn.with_age(one, born, 0).select("id", "yr", "first", F.col("age").alias("completed"), F.col("yob").alias("cohort"))


@query("select id, yr, (y >= 250000)::int as top, (y < 50000)::int as zero, round(case when y < 50000 then 0 else ln(greatest(y, 25000.0)) end, 6) as ln_y, round(least(case when y < 50000 then 0 else ln(greatest(y, 25000.0)) end, ln(250000.0)), 6) as ln_top from p", "panel")
def x10_topcode_features(spark, d):
    return rounded(panel(spark, d).select("id", "yr", *[c.alias(k) for k, c in sc.topcode_features(F.col("y"), F.lit(250000.0), F.lit(FLOOR), "y").items()]))


@query("""with u as (select id, ('0x' || substr(md5('a:' || id), 1, 12))::bigint / 281474976710656.0 as u, ('0x' || substr(md5('b:' || id), 1, 12))::bigint / 281474976710656.0 as v from (select distinct id from p))
select id, round(u, 9) as u, round(sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v), 6) as z from u""", "panel")  # fmt: skip
def x11_random_numbers(spark, d):
    people = panel(spark, d).select("id").distinct()
    return people.select("id", F.round(sc.md5_uniform("a", F.col("id")), 9).alias("u"), F.round(sc.md5_normal("a", "b", F.col("id")), 6).alias("z"))


@query("select c_custkey, c_nationkey::bigint as c_nationkey, 'tinyint' as kind, c_acctbal from customer")
def p10_compressed(spark, d):
    """Whole numbers in the narrowest type that holds them."""
    small = co.compressed(readers.table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
    return small.select(F.col("c_custkey").cast("long").alias("c_custkey"), big("c_nationkey").alias("c_nationkey"), F.typeof("c_nationkey").alias("kind"), "c_acctbal")


@query("select yr, count(*) as n, min_by(id, (y, id)) as least, max_by(id, (y, id)) as most, list(id order by y, id)[1:3]::varchar as first_three from p group by yr", "panel")
def o03_index_sort(spark, d):
    """Where the least and the largest value stand, and the first places of the index that sorts a group."""
    p = panel(spark, d)
    place = F.struct("y", "id")
    three = pn.leading(p, ["yr"], ["y", "id"], "id", 3)
    found = p.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", place).alias("least"), F.max_by("id", place).alias("most"))
    return found.join(three, "yr").select("yr", "n", "least", "most", F.concat(F.lit("["), F.array_join(F.col("leading").cast("array<string>"), ", "), F.lit("]")).alias("first_three"))


@query("select age, round(ln(max(m) over (order by age range between 10 following and 10 following)) - ln(m), 6) as g from (select age, avg(y) as m from g group by age)", "aged")
def e13_decade_growth(spark, d):
    """Log growth of mean income over the next ten ages."""
    means = aged(spark, d).groupBy("age").agg(F.avg("y").alias("m"))  # one row per age
    later = means.select((F.col("age") - 10).alias("age"), F.col("m").alias("m10"))
    return rounded(means.join(later, "age", "left").select("age", (F.ln("m10") - F.ln("m")).alias("g")))
