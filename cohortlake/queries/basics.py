"""Sources, projections, filters, joins, sorts, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import scalar as sc
from cohortlake.functions.quantiles import ranked
from cohortlake.operators import columns as co
from cohortlake.operators import filters as fl
from cohortlake.operators import joins as jn
from cohortlake.operators import panel as pn
from cohortlake.operators import reshape as rs
from cohortlake.queries.registry import FLOOR, aged, big, panel, query, rounded
from cohortlake.sources import lookups, readers


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


YEARS_SQL = f"years(yr, cpi, minwage, taxmax) as (values {_values(lookups.year_rows())})"
EVERY_YEAR = list(range(1995, 2002))


@query("select l_orderkey, l_extendedprice from lineitem where l_shipdate < timestamp '1996-01-01'")
def s02_pruned_scan(spark, d):
    return readers.table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice"], "l_shipdate < timestamp '1996-01-01'")


@query(f"with {YEARS_SQL} select cast(yr as bigint) as yr, cast(cpi as double) as cpi, cast(minwage as double) as minwage, cast(taxmax as double) as taxmax from years")
def s11_inline_table(spark, d):
    return lookups.year_table(spark)


@query("select cast(a as bigint) as a, cast(b as bigint) as b from range(1, 6) x(a), range(1, 4) y(b)")
def s12_grid(spark, d):
    return readers.grid(spark, a=range(1, 6), b=range(1, 4)).select(big("a").alias("a"), big("b").alias("b"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 100000")
def f01_filter(spark, d):
    return readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000))


@query("select p_partkey, p_size from part where p_size between 10 and 20 and p_brand in ('Brand#12', 'Brand#23', 'Brand#34')")
def f02_between_in(spark, d):
    return readers.table(spark, d, "part", ["p_partkey", "p_size"], F.col("p_size").between(10, 20) & F.col("p_brand").isin("Brand#12", "Brand#23", "Brand#34"))


@query("select p_partkey, cast(case when p_size > 25 then 1 when p_size > 10 then 2 else 0 end as bigint) as class, case when p_retailprice > 1000 then p_retailprice end as high from part")
def p03_conditional_gen(spark, d):
    return readers.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, 1).when(F.col("p_size") > 10, 2).otherwise(0).cast("bigint").alias("class"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("high"))


@query("select p_partkey, cast(case when p_size between 1 and 10 then 1 when p_size between 11 and 20 then 2 when p_size between 21 and 35 then 3 when p_size between 36 and 50 then 4 end as bigint) as size_group from part")
def p05_recode_ranges(spark, d):
    return readers.table(spark, d, "part").select("p_partkey", big(sc.recode_ranges(F.col("p_size"), [(1, 10, 1), (11, 20, 2), (21, 35, 3), (36, 50, 4)])).alias("size_group"))


@query("select p_partkey, cast(case when p_size in (48, 49) then null when p_size = 50 then 0 else p_size end as bigint) as size, cast(case when p_size = 47 then 1 else 0 end as bigint) as truncated from part")
def p06_sentinels(spark, d):
    return readers.table(spark, d, "part").select("p_partkey", big(sc.sentinels(F.col("p_size"), [48, 49], [50])).alias("size"), big((F.col("p_size") == 47).cast("int")).alias("truncated"))


@query("select p_partkey, cast(case p_size when 3 then 52 when 4 then 26 when 5 then 12 when 6 then 1 else 0 end as bigint) as times from part")
def p07_frequency_codes(spark, d):
    return readers.table(spark, d, "part").select("p_partkey", big(sc.annual_factor(F.col("p_size"))).alias("times"))


@query("select id, yr, coalesce(nullif(y, 0), 0) as y, coalesce(case when y > 300000 then y end, 0) as high from p", "panel")
def p08_fill_zero(spark, d):
    return panel(spark, d).withColumn("high", F.when(F.col("y") > 300000, F.col("y"))).na.fill(0, ["y", "high"])


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def p09_lenient_cast(spark, d):
    return readers.table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("select p_partkey, coalesce(case when p_size > 20 then p_size end, 0) + coalesce(case when p_retailprice > 1000 then p_retailprice end, 0) as total, case when p_size > 20 then p_size end + case when p_retailprice > 1000 then p_retailprice end as strict_sum from part")
def p11_rowtotal(spark, d):
    parts = readers.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_size")).alias("a"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("b"))
    return parts.select("p_partkey", sc.row_total(["a", "b"]).alias("total"), sc.row_sum(["a", "b"]).alias("strict_sum"))


@query("select l_orderkey, l_linenumber, greatest(l_discount, l_tax) as most, least(l_discount, l_tax) as least_ from lineitem")
def p12_row_extremes(spark, d):
    return readers.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("most"), F.least("l_discount", "l_tax").alias("least_"))


@query("select o_orderkey, cast(o_orderstatus = 'F' as int)::bigint as is_f, cast(o_orderstatus = 'O' as int)::bigint as is_o, cast(o_orderstatus = 'P' as int)::bigint as is_p from orders")
def p13_indicators(spark, d):
    o = readers.table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    return o.select("o_orderkey", *[big((F.col("o_orderstatus") == s).cast("int")).alias(f"is_{s.lower()}") for s in "FOP"])


@query("select o_orderkey, round(round(o_totalprice * power(10, 3 - floor(log10(o_totalprice)))) / power(10, 3 - floor(log10(o_totalprice))), 4) as y4 from orders")
def p14_significant(spark, d):
    return readers.table(spark, d, "orders").select("o_orderkey", F.round(sc.significant(F.col("o_totalprice"), 4), 4).alias("y4"))


@query(f"with {YEARS_SQL} select id, yr, round(y * 100.0 / cpi, 4) as real_y from p join years using (yr)", "panel")
def p16_deflate(spark, d):
    years = lookups.year_table(spark)
    return panel(spark, d).join(F.broadcast(years.select("yr", "cpi")), "yr").select("id", "yr", F.round(F.col("y") * 100.0 / F.col("cpi"), 4).alias("real_y"))


@query(f"with {YEARS_SQL} select cast(yr as bigint) as yr, round(40 * 13 * 0.5 * minwage * 100.0 / cpi, 6) as rmininc from years")
def p17_threshold(spark, d):
    return lookups.year_table(spark).select("yr", F.round(40 * 13 * 0.5 * F.col("minwage") * 100.0 / F.col("cpi"), 6).alias("rmininc"))


@query("select o_orderkey, round(o_totalprice + 2.0 / 3 * o_totalprice * (o_orderkey % 2), 4) as labour from orders")
def p18_composite(spark, d):
    return readers.table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") + F.lit(2.0 / 3) * F.col("o_totalprice") * (F.col("o_orderkey") % 2), 4).alias("labour"))


@query("with c as (select yr, quantile_cont(y, 0.99) as cap from p where y >= 50000 group by yr) select id, yr, round(case when y >= 50000 then least(y, cap) else y end, 4) as y from p join c using (yr)", "panel")
def p19_winsorise(spark, d):
    p = panel(spark, d)
    caps = p.filter(F.col("y") >= FLOOR).groupBy("yr").agg(F.percentile("y", 0.99).alias("cap"))
    return p.join(F.broadcast(caps), "yr").select("id", "yr", F.round(F.when(F.col("y") >= FLOOR, F.least("y", "cap")).otherwise(F.col("y")), 4).alias("y"))


@query("select id, yr, round(y * (1 + (('0x' || substr(md5('jitter:' || id || ':' || yr), 1, 12))::bigint / 281474976710656.0 - 0.5) / 5000), 4) as y from p", "panel")
def p20_jitter(spark, d):
    u = sc.md5_uniform("jitter", F.col("id"), F.col("yr"))
    return panel(spark, d).select("id", "yr", F.round(F.col("y") * (1 + (u - 0.5) / 5000), 4).alias("y"))


@query("select id, yr, age, case when age between 25 and 60 then y end as y from g", "aged")
def p21_age_window(spark, d):
    return aged(spark, d).select("id", "yr", "age", F.when(F.col("age").between(25, 60), F.col("y")).alias("y"))


@query("select id, yr, least(y, 200000.0) as y from p", "panel")
def p22_truncate(spark, d):
    return panel(spark, d).select("id", "yr", F.least("y", F.lit(200000.0)).alias("y"))


@query("select distinct id, yob from g where 2001 - yob + 1 >= 25 and 1995 - yob + 1 <= 60", "aged")
def f03_eligible_cohorts(spark, d):
    return aged(spark, d).filter(fl.eligible_cohort(F.col("yob"), 1995, 2001)).select("id", "yob").distinct()


@query("select distinct id, greatest(0, least(2001, yob + 59, case when id % 10 = 0 then 1999 - 1 else 9998 end) - greatest(1995, yob + 24) + 1)::bigint as years from g", "aged")
def f04_observable_years(spark, d):
    death = F.when(F.col("id") % 10 == 0, F.lit(1999))
    return aged(spark, d).select("id", big(fl.observable_years(F.col("yob"), death, 1995, 2001)).alias("years")).distinct()


@query("select id, yr, y from p where id in (select id from p where y >= 50000 group by id having count(*) >= 5)", "panel")
def f05_min_employment(spark, d):
    return fl.employed_at_least(panel(spark, d), 5, FLOOR).select("id", "yr", "y")


@query("with w as (select *, count(case when y >= 50000 then 1 end) over (partition by id order by yr range between 4 preceding and current row) as nv from p) select id, yr, nv from w where y >= 50000 and nv >= 3", "panel")
def f06_min_recent(spark, d):
    return fl.recently_attached(panel(spark, d), FLOOR).select("id", "yr", "nv")


@query("""with w as (select *, count(case when y >= 50000 then 1 end) over (partition by id order by yr range between 1 preceding and 1 preceding) as one,
count(case when y >= 50000 then 1 end) over (partition by id order by yr range between 4 preceding and current row) as five from g)
select id, yr, age from w where y >= 50000 and case when age <= 26 then one >= 1 else five >= 3 end""", "aged")  # fmt: skip
def f07_young_rule(spark, d):
    return fl.recently_attached_young(aged(spark, d), FLOOR).select("id", "yr", "age")


@query("""select id, yr, y from p where id in (select id from p group by id
having max((yr between 1995 and 1996 and y >= 50000)::int) = 1 and max((yr between 1997 and 1998 and y >= 50000)::int) = 1 and max((yr between 1999 and 2001 and y >= 50000)::int) = 1)""", "panel")  # fmt: skip
def f08_period_attachment(spark, d):
    return fl.attached_in_periods(panel(spark, d), [(1995, 1996), (1997, 1998), (1999, 2001)], FLOOR).select("id", "yr", "y")


@query("with s as (select *, yr - lag(yr) over (partition by id order by yr) as step from p), m as (select *, max(step) over (partition by id) as worst from s) select id, yr from m where worst <= 2", "panel")
def f09_gaps(spark, d):
    return fl.without_gaps(panel(spark, d)).select("id", "yr")


@query("select id, yr from p where id not in (select id from p where y < 20000)", "panel")
def f10_no_bad_rows(spark, d):
    return fl.without_bad(panel(spark, d), F.col("y") < 20000).select("id", "yr")


@query("with m as (select id, min(yr) as first from p group by id) select p.id, p.yr from p where id not in (select p.id from p join m using (id) where yr > first and y < 20000)", "panel")
def f11_stable_households(spark, d):
    return fl.stable_households(panel(spark, d), F.col("y") < 20000).select("id", "yr")


@query("select l_orderkey, l_linenumber from lineitem where l_discount < 0.1 * (l_discount + l_tax)")
def f12_share_exclusion(spark, d):
    return readers.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"]).filter(F.col("l_discount") < 0.1 * (F.col("l_discount") + F.col("l_tax"))).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_totalprice as f from orders where o_totalprice < 100000")
def f13_legitimate(spark, d):
    return readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumnRenamed("o_totalprice", "f").filter(fl.legitimate(F.col("f"), 100000))


@query("select id, cast(max((y >= 400000)::int) as bigint) as ever from p group by id having max((y >= 400000)::int) = 1", "panel")
def f14_ever(spark, d):
    wide = rs.long_to_wide(panel(spark, d), ["id"], "y", EVERY_YEAR)
    flags = wide.select("id", *[(F.col(f"y{t}") >= 400000).alias(f"h{t}") for t in EVERY_YEAR])
    return flags.filter(fl.ever_true([f"h{t}" for t in EVERY_YEAR])).select("id", F.lit(1).cast("bigint").alias("ever"))


# --- joins


@query("""with a as (select id, count(*) as na from p where yr <= 1997 group by id), b as (select id, count(*) as nb from p where yr >= 1998 group by id)
select coalesce(a.id, b.id) as id, na, nb, (case when a.id is not null then 1 else 0 end + case when b.id is not null then 2 else 0 end)::bigint as merge from a full join b on a.id = b.id""", "panel")  # fmt: skip
def j01_full_merge(spark, d):
    p = panel(spark, d)
    a = p.filter("yr <= 1997").groupBy("id").agg(F.count("*").alias("na"))
    b = p.filter("yr >= 1998").groupBy("id").agg(F.count("*").alias("nb"))
    return jn.full_merge(a, b, ["id"]).withColumn("merge", big("merge"))


@query("select o_orderkey, c_mktsegment, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def j02_m1_merge(spark, d):
    c = readers.table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    n = readers.table(spark, d, "nation", ["n_nationkey", "n_name"])
    o = readers.table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("select s_suppkey as id, q.n, (case when q.n is null then 1 else 3 end)::bigint as merge from supplier left join (select l_suppkey, count(*) as n from lineitem where l_quantity > 49 group by 1) q on q.l_suppkey = s_suppkey")
def j03_left_status(spark, d):
    s = readers.table(spark, d, "supplier", ["s_suppkey"]).withColumnRenamed("s_suppkey", "id")
    q = readers.table(spark, d, "lineitem", ["l_suppkey"], "l_quantity > 49").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return jn.merge_keep(s, q, ["id"], (1, 3)).withColumn("merge", big("merge"))


@query("select o_orderkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by 1")
def j04_inner(spark, d):
    o = readers.table(spark, d, "orders", ["o_orderkey"], "o_orderpriority = '1-URGENT'")
    i = readers.table(spark, d, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return jn.merge_keep(o, i, ["o_orderkey"], (3,)).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("select g.id, g.yr, c.c_mktsegment, q.m from g left join customer c on c.c_custkey = g.id left join (select yob, yr, round(avg(y), 4) as m from g group by 1, 2) q on q.yob = g.yob and q.yr = g.yr", "aged")
def j05_left_keys(spark, d):
    g = aged(spark, d)
    c = readers.table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "id")
    q = g.groupBy("yob", "yr").agg(F.round(F.avg("y"), 4).alias("m"))
    return g.join(c, "id", "left").join(F.broadcast(q), ["yob", "yr"], "left").select("id", "yr", "c_mktsegment", "m")


@query("select r_name, n_name from region cross join nation")
def j06_cross(spark, d):
    return readers.table(spark, d, "region", ["r_name"]).crossJoin(F.broadcast(readers.table(spark, d, "nation", ["n_name"])))


@query(f"with ages(age, agedum) as (values {_values([(25 + i, x) for i, x in enumerate(lookups.AGE_PROFILE)])}) select id, yr, round(y / agedum, 6) as rel from g join ages using (age)", "aged")
def j07_positional(spark, d):
    return aged(spark, d).join(F.broadcast(lookups.age_table(spark)), "age").select("id", "yr", F.round(F.col("y") / F.col("agedum"), 6).alias("rel"))


@query("select a.id, a.yr, a.y, b.y as y_next from p a left join p b on b.id = a.id and b.yr = a.yr + 1", "panel")
def j08_calendar_lead(spark, d):
    return pn.calendar_shift(panel(spark, d), ["y"], 1, "_next").select("id", "yr", "y", "y_next")


KNOTS = [(0.0, 0.0), (50000.0, 10.0), (100000.0, 15.0), (200000.0, 40.0), (400000.0, 50.0)]


@query(f"""with k0(x0, y0) as (values {_values(KNOTS)}), k as (select x0::double as x0, y0::double as y0 from k0), b as (select x0, y0, lead(x0) over (order by x0) as x1, lead(y0) over (order by x0) as y1 from k)
select o_orderkey, round((case when o_totalprice >= 400000 then 50.0 else y0 + (o_totalprice - x0) * ((y1 - y0) / (x1 - x0)) end)::double, 8) as v
from orders join b on o_totalprice >= x0 and (o_totalprice < x1 or x1 is null)""")  # fmt: skip
def j09_interp_lookup(spark, d):
    knots = spark.createDataFrame(KNOTS, "x double, y double")
    return jn.interpolated(readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", knots, "v").select("o_orderkey", F.round("v", 8).alias("v"))


GRID = [(x, y, x * 2 + y * y / 10) for x in (0.0, 10.0, 25.0, 50.0) for y in (0.0, 20.0, 60.0)]


@query(f"""with k(gx, gy, gz) as (values {_values(GRID)}), xs as (select gx as x0, lead(gx) over (order by gx) as x1 from (select distinct gx from k)), ys as (select gy as y0, lead(gy) over (order by gy) as y1 from (select distinct gy from k)),
q as (select l_orderkey, l_linenumber, cast(l_quantity as double) as x, least(l_linenumber * 9.0, 60.0) as y from lineitem),
b as (select q.*, x0, x1, y0, y1, (x - x0) / (x1 - x0) as u, (y - y0) / (y1 - y0) as v from q join xs on x >= x0 and (x < x1 or (x = 50 and x1 = 50)) and x1 is not null join ys on y >= y0 and (y < y1 or (y = 60 and y1 = 60)) and y1 is not null)
select l_orderkey, l_linenumber, round(a.gz * (1 - u) * (1 - v) + c.gz * u * (1 - v) + e.gz * (1 - u) * v + f.gz * u * v, 6) as z
from b join k a on a.gx = x0 and a.gy = y0 join k c on c.gx = x1 and c.gy = y0 join k e on e.gx = x0 and e.gy = y1 join k f on f.gx = x1 and f.gy = y1""")  # fmt: skip
def j10_bilinear(spark, d):
    grid = spark.createDataFrame(GRID, "gx double, gy double, gz double")
    q = readers.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.least(F.col("l_linenumber") * 9.0, F.lit(60.0)).alias("y"))
    return jn.bilinear(q, "x", "y", grid, "z").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query("with k(m) as (values (5.0), (12.0), (20.0), (31.0), (44.0)) select l_orderkey, l_linenumber, (select min_by(m, abs(m - l_quantity) * 1000 + m / 1000) from k)::double as mid from lineitem")
def j11_nearest(spark, d):
    mids = spark.createDataFrame([(x,) for x in (5.0, 12.0, 20.0, 31.0, 44.0)], "m double")
    return jn.nearest(readers.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]), "l_quantity", mids, "m", "mid").select("l_orderkey", "l_linenumber", "mid")


@query(f"with ages(age, agedum) as (values {_values([(25 + i, x) for i, x in enumerate(lookups.AGE_PROFILE)])}) select g.id, g.yr, g.age, agedum::double as agedum from g join ages on ages.age = least(greatest(g.age, 25), 60)", "aged")
def j12_clamped(spark, d):
    return jn.clamped(aged(spark, d), "age", lookups.age_table(spark), "age", 25, 60).select("id", "yr", "age", "agedum")


@query("select id, yr, case when yr = 1996 and id % 2 = 0 then 0.0 else y end as y from p", "panel")
def j13_anti_replace(spark, d):
    p = panel(spark, d)
    new = p.filter("yr = 1996 and id % 2 = 0").select("id", "yr", F.lit(0.0).alias("y"))
    return jn.replaced(p, new, ["id", "yr"]).select("id", "yr", "y")


@query(f"with {YEARS_SQL}, x as (select cast(range as bigint) as yr from range(1950, 2021)) select x.yr, years.cpi::double as cpi from x join years on years.yr = least(greatest(x.yr, 1959), 2013)")
def j14_extrapolated(spark, d):
    return jn.clamped(spark.range(1950, 2021).withColumnRenamed("id", "yr"), "yr", lookups.year_table(spark).select("yr", "cpi"), "yr", 1959, 2013).select("yr", "cpi")


# --- sorts, top-k, sets


@query("select id, yr, hi, row_number() over (partition by yr order by hi nulls last, id) as k, count(hi) over (partition by yr) as n from (select id, yr, case when y >= 100000 then y end as hi from p)", "panel")
def o02_missing_last(spark, d):
    p = panel(spark, d).select("id", "yr", F.when(F.col("y") >= 100000, F.col("y")).alias("hi"))
    from pyspark.sql import Window

    w = Window.partitionBy("yr")
    return p.withColumn("k", big(F.row_number().over(w.orderBy(F.asc_nulls_last("hi"), "id")))).withColumn("n", F.count("hi").over(w))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def o05_topk(spark, d):
    return readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy("o_totalprice", "o_orderkey").limit(25)


@query("select f, min(l_orderkey) as i from (select l_quantity as f, l_orderkey from lineitem) group by f order by f limit 10")
def o06_topk_distinct(spark, d):
    rows = readers.table(spark, d, "lineitem", ["l_quantity", "l_orderkey"])
    return rows.groupBy(F.col("l_quantity").alias("f")).agg(F.min("l_orderkey").alias("i")).orderBy("f").limit(10)


@query("select o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) as best, min(o_totalprice) as f from orders group by 1")
def o07_argmin(spark, d):
    return readers.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]).groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.min("o_totalprice").alias("f"))


@query("select c_custkey as k, c_acctbal as bal, 'c' as kind, null::varchar as extra from customer union all select s_suppkey, s_acctbal, 's', s_name from supplier")
def u01_append(spark, d):
    c = readers.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit("c").alias("kind"))
    s = readers.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.lit("s").alias("kind"), F.col("s_name").alias("extra"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select distinct l_returnflag, l_linestatus from lineitem")
def u02_dedupe(spark, d):
    return readers.table(spark, d, "lineitem", ["l_returnflag", "l_linestatus"]).dropDuplicates()


# --- reshapes


@query("select id, yr, y from p", "panel")
def r01_wide_to_long(spark, d):
    wide = rs.long_to_wide(panel(spark, d), ["id"], "y", EVERY_YEAR)
    return rs.wide_to_long(wide, ["id"], ["y"], EVERY_YEAR)


@query("select o_custkey as id, cast(year(o_orderdate) as bigint) as yr, round(sum(o_totalprice), 2) as y, count(*)::double as n from orders group by 1, 2")
def r02_multi_stub(spark, d):
    long = readers.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), big(F.year("o_orderdate")).alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count("*").cast("double").alias("n"))
    wide = rs.long_to_wide(long, ["id"], "y", EVERY_YEAR).join(rs.long_to_wide(long, ["id"], "n", EVERY_YEAR), "id")
    return rs.wide_to_long(wide, ["id"], ["y", "n"], EVERY_YEAR)


@query("select id, age, y from g where age between 25 and 60", "aged")
def r03_age_index(spark, d):
    return aged(spark, d).filter(F.col("age").between(25, 60)).select("id", "age", "y")


@query("select id, " + ", ".join(f"max(case when yr = {t} then y end) as y{t}" for t in EVERY_YEAR) + " from p group by id", "panel")
def r04_pivot(spark, d):
    return rs.long_to_wide(panel(spark, d), ["id"], "y", EVERY_YEAR)


@query("select id, age - 25 as j, y from g where age between 25 and 60 union all select id, j, 0.0 from (select distinct id from g where age between 25 and 60), (select unnest(range(0, 36)) as j) where (id, j + 25) not in (select (id, age) from g)", "aged")
def r05_tensor(spark, d):
    dense = rs.dense_ages(aged(spark, d), 25, 60)
    return rs.matrix_to_long(dense, 0).select("id", F.col("age").alias("j"), "y")


@query("select r_regionkey, 'c_' || cast(1900 + r_regionkey as varchar) as header, cast(1900 + r_regionkey as bigint) as cohort from region")
def r06_header_parse(spark, d):
    h = F.concat(F.lit("c_"), (F.col("r_regionkey") + 1900).cast("string"))
    return readers.table(spark, d, "region", ["r_regionkey"]).withColumn("header", h).withColumn("cohort", big(F.right("header", F.lit(4))))


@query("""with b as (select id, min(yr) as a, max(yr) as z, min_by(y, yr) as f, max_by(y, yr) as l, count(*) as n from p group by id),
x as (select id, yr - a + 3 as pos, y from (select p.*, a from p join b using (id) where n = 7) union all select id, i, f * (0.1 + 0.9 * i / 3) from b, (values (0), (1), (2)) t(i) where n = 7 union all select id, 9 + k, l * power(1.01, k) from b, (values (1), (2)) t(k) where n = 7)
select id, pos::bigint as pos, round(y, 4) as y from x""", "panel")  # fmt: skip
def r07_extend(spark, d):
    full = panel(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("yr", "y"))), lambda s: s["y"]).alias("y")).filter(F.size("y") == 7)
    out = full.select("id", F.posexplode(rs.extended(F.col("y"), 3, 2)).alias("pos", "y"))
    return out.select("id", big("pos").alias("pos"), F.round("y", 4).alias("y"))


@query("select 'm' as grp, yr as i, 0::bigint as j, 0::bigint as k, 0::bigint as l, round(avg(y), 4) as value, (row_number() over (order by yr) - 1) as pos from p group by yr", "panel")
def r08_flatten(spark, d):
    zero = F.lit(0).cast("bigint")
    cells = panel(spark, d).groupBy(F.col("yr").alias("i")).agg(F.round(F.avg("y"), 4).alias("value")).select(F.lit("m").alias("grp"), "i", zero.alias("j"), zero.alias("k"), zero.alias("l"), "value")
    return rs.flattened(cells)


@query("select o_orderkey, round(ln(o_totalprice), 6) as a, round(sqrt(o_totalprice), 6) as b, floor(o_totalprice)::bigint as c, ceil(o_totalprice)::bigint as e, round(1 / (1 + exp(-(o_totalprice / 100000 - 2))), 6) as f, least(greatest(o_totalprice, 50000.0), 150000.0) as g, year(o_orderdate)::bigint as yr from orders")
def x01_scalars(spark, d):
    y = F.col("o_totalprice")
    return readers.table(spark, d, "orders").select("o_orderkey", F.round(F.ln(y), 6).alias("a"), F.round(F.sqrt(y), 6).alias("b"), big(F.floor(y)).alias("c"), big(F.ceil(y)).alias("e"), F.round(sc.logistic(y / 100000 - 2), 6).alias("f"), sc.clip(y, 50000.0, 150000.0).alias("g"), big(F.year("o_orderdate")).alias("yr"))


@query("select l_orderkey, l_linenumber, l_discount as a, l_tax as b, round(l_discount * l_discount, 8) as a_2, round(l_tax * l_tax, 8) as b_2, round(l_discount * l_tax, 8) as a_b from lineitem")
def x04_polynomials(spark, d):
    rows = readers.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    p = sc.polynomial(["a", "b"])
    return rounded(rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in p.items()]), 8)


@query("select trim('  ' || n_name || ' ') as a, right(n_name, 4) as b, split_part(n_name || ',x', ',', 2) as c, (n_name like 'I%')::int::bigint as e from nation")
def x08_strings(spark, d):
    n = F.col("n_name")
    return readers.table(spark, d, "nation").select(F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("a"), F.right(n, F.lit(4)).alias("b"), F.split(F.concat(n, F.lit(",x")), ",")[1].alias("c"), big(n.like("I%").cast("int")).alias("e"))


@query("select id, yr, row_number() over (order by y, id, yr) as k, count(*) over () as n from p", "panel")
def o01_global_rank(spark, d):
    return ranked(panel(spark, d), [], ["y", "id", "yr"]).select("id", "yr", big("_k").alias("k"), big("_n").alias("n"))


@query("select c_custkey, c_name, c_nationkey from customer")
def p01_wildcards(spark, d):
    return co.keep(co.drop(readers.table(spark, d, "customer"), "c_acct*", "c_mkt*"), "c_*")


@query("select c_custkey as id, c_acctbal as income, null::varchar as segment, 1999 as year from customer where c_custkey % 2 = 0 union all select c_custkey, c_acctbal, c_mktsegment, 2001 from customer where c_custkey % 2 = 1")
def p02_renamed_waves(spark, d):
    c = readers.table(spark, d, "customer")
    frames = {1999: c.filter("c_custkey % 2 = 0"), 2001: c.filter("c_custkey % 2 = 1")}
    names = {1999: {"c_custkey": "id", "c_acctbal": "income"}, 2001: {"c_custkey": "id", "c_acctbal": "income", "c_mktsegment": "segment"}}
    return co.waves(frames, names)


@query("select r_name, r_regionkey from region")
def p04_order(spark, d):
    return co.ordered(readers.table(spark, d, "region"), "r_name")


@query("select n_nationkey, n_name from nation")
def p15_labels(spark, d):
    return co.labelled(readers.table(spark, d, "nation"), {"n_name": "name of the nation"}).select("n_nationkey", "n_name")


@query("select p_partkey, cast(case when p_size in (9, 8) then null else p_size end as bigint) as p_size, cast(case when p_size = 7 then 1 else 0 end as bigint) as cut from part")
def p06_nines(spark, d):
    out = co.recoded_sentinels(readers.table(spark, d, "part", ["p_partkey", "p_size"]), ["p_size"], 1, "cut")
    return out.select("p_partkey", big("p_size").alias("p_size"), big("cut").alias("cut"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders")
def w05_row_id(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return readers.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate"]).select("o_custkey", "o_orderkey", big(F.row_number().over(w)).alias("k"))
