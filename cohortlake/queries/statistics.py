"""Group statistics, percentile rules and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu
from cohortlake.operators import distributions as ds
from cohortlake.operators import panel as pn
from cohortlake.operators import regression as rg
from cohortlake.queries.registry import FLOOR, aged, big, panel, query, rounded
from cohortlake.sources import readers

# Central moments of y by group, for the SQL twins.
CENTRAL = "c as (select {k}, avg(y) as m from {t} group by {k}), z as (select t.{k}, count(*) as n, avg(m) as mean, stddev_samp(y) as sd, avg(power(y - m, 2)) as m2, avg(power(y - m, 3)) as m3, avg(power(y - m, 4)) as m4, min(y) as lo, max(y) as hi from {t} t join c on c.{k} = t.{k} group by t.{k})"
BY_YEAR = CENTRAL.format(k="yr", t="p")


def type2(p: float, v: str = "y") -> str:
    """SQL of the averaged percentile over ranked rows (k, n)."""
    x = f"round(n * {p} / 100, 9)"
    low = f"greatest(ceil({x}), 1)"
    return f"avg(case when k = {low} or k = (case when {x} = floor({x}) then greatest(least(floor({x}) + 1, n), 1) else {low} end) then {v} end)"


def ranked_sql(key: str, value: str = "y", source: str = "p") -> str:
    return f"select *, row_number() over (partition by {key} order by {value}) as k, count(*) over (partition by {key}) as n from {source} where {value} is not null"


@query(f"with {BY_YEAR} select yr, n, round(mean, 4) as mean, round(sd, 4) as sd, round(m3 / power(m2, 1.5), 6) as skew, round(m4 / power(m2, 2), 6) as kurt, lo as min, hi as max from z", "panel")
def a01_group_moments(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y"), 4, skew=6, kurt=6)


@query(f"with {BY_YEAR}, r as ({ranked_sql('yr')}), q as (select yr, {', '.join(f'round({type2(p)}, 4) as {qu.name_of(p)}' for p in qu.NINE)} from r group by yr) select z.yr, z.n, round(mean, 4) as mean, round(sd, 4) as sd, {', '.join(map(qu.name_of, qu.NINE))} from z join q using (yr)", "panel")
def a02_dist_stats(spark, d):
    rows = qu.ranked(panel(spark, d), ["yr"], ["y"])
    y = F.col("y")
    return rounded(rows.groupBy("yr").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), *[qu.percentile(y, p, "averaged").alias(qu.name_of(p)) for p in qu.NINE]), 4)


@query(f"with r as ({ranked_sql('yr')}) select yr, count(*) as n, round(avg(y), 4) as mean, round({type2(50)}, 4) as p50, round(stddev_samp(y), 4) as sd, round({type2(1)}, 4) as p1, round({type2(99)}, 4) as p99 from r group by yr", "panel")
def a03_short_stats(spark, d):
    rows, y = qu.ranked(panel(spark, d), ["yr"], ["y"]), F.col("y")
    return rounded(rows.groupBy("yr").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), *[qu.percentile(y, p, "averaged").alias(qu.name_of(p)) for p in (1, 50, 99)]), 4)


@query("select yr, count(*) as n, round(avg(y), 4) as mean from p group by yr", "panel")
def a04_mean_only(spark, d):
    return rounded(mo.aggregate(panel(spark, d), ["yr"], "y", ["n", "mean"]), 4)


@query(f"with r as ({ranked_sql('yr')}) select yr, {', '.join(f'round({type2(p)}, 4) as {qu.name_of(p)}' for p in qu.FIFTEEN)} from r group by yr", "panel")
def a05_percentiles15(spark, d):
    return rounded(qu.group_percentiles(panel(spark, d), ["yr"], "y"), 4)


@query("select yr, count(*) as n, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as sd, min(y) as min, max(y) as max from p group by grouping sets ((yr), ())", "panel")
def a06_total_row(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", total=True).drop("skew", "kurt"), 4)


@query("select l_returnflag, round(avg(l_quantity), 6) as l_quantity, round(avg(l_discount), 6) as l_discount, round(avg(l_tax), 6) as l_tax from lineitem group by 1")
def a07_collapse(spark, d):
    return rounded(readers.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]))


@query("select id, yr, round(avg(y) over w, 4) as mean, round(stddev_samp(y) over w, 4) as sd, count(y) over w as n, min(y) over w as lo, max(y) over w as hi, round(sum(y) over w, 2) as total, round(median(y) over w, 4) as med, round(case when count(y) over w > 1 then corr(y, yr) over w end, 6) as r from p window w as (partition by id)", "panel")
def a08_group_stats_on_rows(spark, d):
    w = Window.partitionBy("id")
    y = F.col("y")
    p = panel(spark, d)
    stats = p.select("id", "yr", F.avg(y).over(w).alias("mean"), F.stddev_samp(y).over(w).alias("sd"), F.count(y).over(w).alias("n"), F.min(y).over(w).alias("lo"), F.max(y).over(w).alias("hi"), F.sum(y).over(w).alias("total"), F.percentile(y, 0.5).over(w).alias("med"), F.corr("y", "yr").over(w).alias("r"))
    return rounded(stats, 4, r=6, total=2)


@query("select id, yr from (select *, row_number() over (partition by id order by yr) as k from p) where k = 1", "panel")
def a09_tag(spark, d):
    return panel(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("yr"))).filter("k = 1").select("id", "yr")


PROBS = (1, 10, 25, 50, 75, 90, 99)


def _rule(name: str, sql) -> None:
    columns = ", ".join(f"round({sql(p)}, 4) as {qu.name_of(p)}" for p in PROBS)
    rule = {"a10a_pctile_type2": "averaged", "a10b_pctile_floor": "floor", "a10c_pctile_type7": "linear", "a10d_pctile_type1": "inverted", "a10e_pctile_type6": "exclusive"}[name]

    def run(spark, d):
        return rounded(qu.group_percentiles(readers.table(spark, d, "lineitem", ["l_returnflag", "l_quantity"]), ["l_returnflag"], "l_quantity", PROBS, rule), 4)

    run.__name__ = name
    query(f"with r as ({ranked_sql('l_returnflag', 'l_quantity', 'lineitem')}) select l_returnflag, {columns} from r group by 1")(run)


def _between(h: str) -> str:
    return f"sum(case when k = floor({h}) then l_quantity * (1 - ({h} - floor({h}))) when k = floor({h}) + 1 then l_quantity * ({h} - floor({h})) end)"


_rule("a10a_pctile_type2", lambda p: type2(p, "l_quantity"))
_rule("a10b_pctile_floor", lambda p: f"max(case when k = least(n, floor(round(n * {p} / 100, 9)) + 1) then l_quantity end)")
_rule("a10c_pctile_type7", lambda p: f"quantile_cont(l_quantity, {p / 100})")
_rule("a10d_pctile_type1", lambda p: f"max(case when k = greatest(ceil(round(n * {p} / 100, 9)), 1) then l_quantity end)")
_rule("a10e_pctile_type6", lambda p: _between(f"least(greatest(round((n + 1) * {p}.0 / 100, 9), 1), n)"))


@query("with r as (" + ranked_sql("yr") + ") select yr, " + ", ".join(f"round(avg(case when abs(k - least(n, floor(round(n * {p} / 100, 9)) + 1)) <= 5 then y end), 4) as {qu.name_of(p)}" for p in (10, 50, 90)) + " from r group by yr", "panel")
def a11_smoothed_pctile(spark, d):
    return rounded(qu.smoothed_percentiles(panel(spark, d), ["yr"], "y", (10, 50, 90)), 4)


@query("select yr, count(*) as n, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as sd, round(skewness(y), 6) as skew, round(kurtosis(y), 6) as kurt from p group by yr", "panel")
def a12_moments_unbiased(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", "unbiased", extremes=False), 4, skew=6, kurt=6)


@query(f"with {BY_YEAR} select yr, n, round(mean, 4) as mean, round(sd, 4) as sd, round(m3 / power(sd, 3), 6) as skew, round(m4 / power(sd, 4), 6) as kurt from z", "panel")
def a13_moments_sampled(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", "sampled", extremes=False), 4, skew=6, kurt=6)


@query(f"with {BY_YEAR} select yr, n, round(mean, 4) as mean, round(sqrt(m2), 4) as sd, round(m3 / power(m2, 1.5), 6) as skew, round(m4 / power(m2, 2), 6) as kurt from z", "panel")
def a14_moments_population(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", "population", extremes=False), 4, skew=6, kurt=6)


@query("select yr, count(*) as n, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as sd, round(skewness(y), 6) as skew, round(kurtosis(y) + 3, 6) as kurt from p group by yr", "panel")
def a15_arc_moments(spark, d):
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", "arc", extremes=False), 4, skew=6, kurt=6)


def _robust(name: str, expression, sql: str) -> None:
    def run(spark, d):
        q = qu.group_percentiles(panel(spark, d), ["yr"], "y")
        return rounded(q.select("yr", expression().alias("v")))

    run.__name__ = name
    cuts = ", ".join(f"{type2(p)} as {qu.name_of(p)}" for p in qu.FIFTEEN)
    query(f"with r as ({ranked_sql('yr')}), q as (select yr, {cuts} from r group by yr) select yr, round({sql}, 6) as v from q", "panel")(run)


c = F.col
_robust("a16_kelley", lambda: mo.kelley(c("p10"), c("p50"), c("p90")), "((p90 - p50) - (p50 - p10)) / (p90 - p10)")
_robust("a17_hinkley", lambda: mo.kelley(c("p1"), c("p50"), c("p99")), "((p99 - p50) - (p50 - p1)) / (p99 - p1)")
_robust("a18_moors", lambda: mo.moors(c("p12_5"), c("p25"), c("p37_5"), c("p62_5"), c("p75"), c("p87_5")), "((p87_5 - p62_5) + (p37_5 - p12_5)) / (p75 - p25)")
_robust("a19_crow", lambda: mo.crow(c("p2_5"), c("p25"), c("p75"), c("p97_5")), "(p97_5 - p2_5) / (p75 - p25)")
_robust("a20_spreads", lambda: (c("p90") - c("p50")) / (c("p50") - c("p10")), "(p90 - p50) / (p50 - p10)")


@query("select yr, round(avg(x), 4) as mean, round(var_samp(x), 2) as var from (select yr, case when y < 900000 then y end as x from p) group by yr", "panel")
def a21_mean_var(spark, d):
    p = panel(spark, d).withColumn("x", F.when(F.col("y") < 900000, F.col("y")))
    return rounded(mo.aggregate(p, ["yr"], "x", ["mean", "var"]), 4, var=2)


@query("select a.yr as key_a, b.yr as key_b, count(*) as n, round(covar_samp(ln(a.y), ln(b.y)), 6) as cov, round(corr(ln(a.y), ln(b.y)), 6) as corr from p a join p b on a.id = b.id and a.yr <= b.yr group by 1, 2", "panel")
def a22_autocov(spark, d):
    return rounded(pn.autocovariances(panel(spark, d).withColumn("ly", F.ln("y")), "ly", "yr"))


@query("""with r as (select y, row_number() over (order by y) as k, count(*) over () as n from p), e as (select max(case when k = floor(1.0 * n / 100) + 1 then y end) as lo, max(case when k = floor(99.0 * n / 100) + 1 then y end) as hi, max(n) as n from r),
b as (select case when y <= lo then 1 when y > hi then 21 else least(greatest(1 + ceil(round((y - lo) / ((hi - lo) / 19), 9)), 2), 20) end::bigint as bin, n from p, e) select bin, count(*) as n, round(count(*) * 1.0 / max(b.n), 8) as share from b group by bin""", "panel")  # fmt: skip
def a23_histogram(spark, d):
    return rounded(ds.histogram(panel(spark, d), "y", bins=20, cutoff=1.0), 8)


@query(f"""with r as (select l_quantity::double as x, row_number() over (order by l_quantity) as k, count(*) over () as n from lineitem), s as (select stddev_samp(x) as sd, {type2(75, 'x')} - {type2(25, 'x')} as iqr, count(*) as n, min(x) as lo, max(x) as hi from r),
h as (select *, 0.9 * least(sd, iqr / 1.349) * power(n, -0.2) as h from s), g as (select i::bigint as i, lo - h + i * (hi - lo + 2 * h) / 49 as x_at, h, n from h, range(0, 50) t(i)), v as (select l_quantity::double as x, count(*) as c from lineitem group by 1)
select i, round(x_at, 6) as at, round(sum(case when abs((x - x_at) / h) < sqrt(5.0) then c * 0.75 * (1 - power((x - x_at) / h, 2) / 5) / sqrt(5.0) else 0 end) / (max(n) * max(h)), 8) as density from g, v group by i, x_at""")  # fmt: skip
def a24_kdensity(spark, d):
    return rounded(ds.kernel_density(readers.table(spark, d, "lineitem", ["l_quantity"]), "l_quantity", points=50), 8, at=6)


@query("""with v as (select l_quantity::double as x, count(*)::double as f from lineitem group by 1), t as (select sum(f) as s from v), c as (select x, f / s as p, sum(f) over (order by x) / s as cdf from v, t), m as (select sum(x * p) as mean from c)
select round(max(m.mean), 6) as mean, round(sqrt(sum(p * power(x - mean, 2))), 6) as sd, round(sum(p * power(x - mean, 3)) / power(sum(p * power(x - mean, 2)), 1.5), 6) as skew, round(sum(p * power(x - mean, 4)) / power(sum(p * power(x - mean, 2)), 2), 6) as kurt, min(case when cdf >= 0.5 then x end) as median, round(sum(case when x > 45 then p else 0 end), 8) as tail from c, m""")  # fmt: skip
def a25_density_moments(spark, d):
    grid = readers.table(spark, d, "lineitem", ["l_quantity"]).groupBy(F.col("l_quantity").cast("double").alias("x")).agg(F.count("*").cast("double").alias("f"))
    return rounded(ds.density_moments(grid, "x", "f", tail=45.0), 6, tail=8)


@query("with e as (select id, count(case when y >= 50000 then 1 end) as emp from p group by id) select i::bigint as i, round(100.0 * (select count(*) from e where emp <= i) / (select count(*) from e), 6) as pct from range(0, 8) t(i)", "panel")
def a26_ecdf(spark, d):
    emp = panel(spark, d).groupBy("id").agg(F.count(F.when(F.col("y") >= FLOOR, 1)).alias("emp"))
    return rounded(ds.empirical_cdf(emp, "emp", 7))


@query("with r as (" + ranked_sql("yr") + ") select yr, " + ", ".join(f"round(sum(case when k >= floor(round(n * {p} / 100, 9)) + 1 then y else 0 end) / sum(y), 6) as top{p}" for p in (50, 90, 99)) + " from r group by yr", "panel")
def a27_topshare(spark, d):
    return rounded(qu.top_shares(panel(spark, d), ["yr"], "y", (50, 90, 99)))


@query("with e as (select id, count(case when y >= 50000 then 1 end) as worked from p group by id) select age, worked, count(*) as n, round(avg((y >= 50000)::int), 6) as employed from g join e using (id) where age between 25 and 60 group by 1, 2", "aged")
def a28_emp_by_age(spark, d):
    return rounded(ds.employment_by_age(aged(spark, d).filter(F.col("age").between(25, 60)), aged(spark, d), FLOOR))


@query("select o_orderstatus, count(*) as n, count(case when o_totalprice > 100000 then 1 end) as n_high from orders group by 1")
def a29_counts(spark, d):
    return readers.table(spark, d, "orders", ["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_high"))


@query("select count(distinct l_returnflag) as l_returnflag, count(distinct l_quantity) as l_quantity, count(distinct (l_returnflag, l_quantity)) as joint_ from lineitem")
def a30_distinct(spark, d):
    return ds.distinct_counts(readers.table(spark, d, "lineitem"), ["l_returnflag", "l_quantity"], joint="joint_")


@query("select o_orderpriority, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 8) as share from orders group by 1")
def a31_share(spark, d):
    return rounded(ds.shares(readers.table(spark, d, "orders", ["o_orderpriority"]), ["o_orderpriority"]), 8)


@query("with b as (select *, ntile_ from (select *, 1 + (y > 100000)::int + (y > 200000)::int as ntile_ from p)) select ntile_::bigint as bin, round(sum(case when id % 3 = 0 then 1 else 0 end) * 1.0 / count(*), 8) as stay from b group by 1", "panel")
def a32_conditional_ratio(spark, d):
    y = F.col("y")
    b = panel(spark, d).withColumn("bin", (1 + (y > 100000).cast("int") + (y > 200000).cast("int")).cast("bigint"))
    return rounded(b.groupBy("bin").agg((F.count_if(F.col("id") % 3 == 0) / F.count("*")).alias("stay")), 8)


@query("select yr, count(*) as n, round(avg(ln(y)), 6) as meanlog, round(stddev_samp(ln(y)), 6) as sdlog, round(skewness(ln(y)), 6) as skewlog, round(kurtosis(ln(y)), 6) as kurtlog, round(max(y) - min(y), 2) as span from p group by yr", "panel")
def a33_registry(spark, d):
    return rounded(mo.aggregate(panel(spark, d), ["yr"], "y", ["n", "meanlog", "sdlog", "skewlog", "kurtlog", ("span", lambda x: F.max(x) - F.min(x))]), 6, span=2)


@query("with s as (select least((age - 25) // 5 + 1, 7) as bin, yr, avg(y) as m from g where age >= 25 group by 1, 2), t as (select bin, avg(m) as m from s group by bin) select (case when bin <= 2 then 1 else 2 end)::bigint as grp, round(avg(m), 4) as mean from t group by 1", "aged")
def a34_nested_means(spark, d):
    from cohortlake.functions.scalar import age_bin

    s = aged(spark, d).filter("age >= 25").groupBy(age_bin(F.col("age")).alias("bin"), "yr").agg(F.avg("y").alias("m")).groupBy("bin").agg(F.avg("m").alias("m"))
    return rounded(pn.mapped_bins(s, "bin", {1: (1, 2), 2: (3, 7)}, "grp").groupBy(big("grp").alias("grp")).agg(F.avg("m").alias("mean")), 4)


@query("""with u as (select id, rep, ('0x' || substr(md5('boot:' || rep || ':' || id), 1, 12))::bigint / 281474976710656.0 as u from (select distinct id from p), range(1, 9) t(rep)),
t as (select id, rep, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336], lambda c: c <= u)) as times from u),
s as (select rep, yr, sum(times * y) / sum(times) as m from p join t using (id) where times > 0 group by 1, 2) select yr, count(*) as reps, round(avg(m), 3) as mean, round(stddev_samp(m) / sqrt(count(*)), 4) as se from s group by yr""", "panel")  # fmt: skip
def a35_boot_se(spark, d):
    s = rg.bootstrap(panel(spark, d), 8, most=11).groupBy("rep", "yr").agg(F.avg("y").alias("m"))
    return rounded(rg.replicate_errors(s, ["yr"], "m"), 4, mean=3)


@query("""with r as (select *, row_number() over (partition by yr order by y, id) - 1 as k, count(*) over (partition by yr) as n from p), b as (select *, floor(k * 10 / n)::bigint + 1 as dec from r)
select dec, count(*) as n, count(case when f1.y < 50000 then 1 end) as low1, count(case when f2.y < 50000 then 1 end) as low2 from b left join p f1 on f1.id = b.id and f1.yr = b.yr + 1 left join p f2 on f2.id = b.id and f2.yr = b.yr + 2 where b.y < 1e9 group by dec""", "panel")  # fmt: skip
def a36_persistence(spark, d):
    p = pn.calendar_shift(pn.calendar_shift(panel(spark, d), ["y"], 1, "_1"), ["y"], 2, "_2")
    r = qu.ranked(p, ["yr"], ["y", "id"]).withColumn("dec", (F.floor((F.col("_k") - 1) * 10 / F.col("_n")) + 1).cast("bigint"))
    return r.groupBy("dec").agg(F.count("*").alias("n"), F.count_if(F.col("y_1") < FLOOR).alias("low1"), F.count_if(F.col("y_2") < FLOOR).alias("low2"))


@query("select l_returnflag, round(avg((l_discount > 0.05)::int), 8) as share from lineitem group by 1")
def a37_incidence(spark, d):
    return rounded(readers.table(spark, d, "lineitem", ["l_returnflag", "l_discount"]).groupBy("l_returnflag").agg(F.avg((F.col("l_discount") > 0.05).cast("int")).alias("share")), 8)


@query("with a as (select year(o_orderdate)::bigint as yr, avg(o_totalprice) as m from orders group by 1) select yr, round(m / (select m from a where yr = 1996), 8) as idx from a")
def a38_yearly_index(spark, d):
    a = readers.table(spark, d, "orders", ["o_orderdate", "o_totalprice"]).groupBy(big(F.year("o_orderdate")).alias("yr")).agg(F.avg("o_totalprice").alias("m"))
    base = a.filter("yr = 1996").select(F.col("m").alias("b"))
    return rounded(a.crossJoin(F.broadcast(base)).select("yr", (F.col("m") / F.col("b")).alias("idx")), 8)


@query(f"""with d as (select ln(b.y / a.y) as x from p a join p b on b.id = a.id and b.yr = a.yr + 1), r as (select x, row_number() over (order by x) as k, count(*) over () as n from d), s as (select stddev_samp(x) as sd, {type2(75, 'x')} - {type2(25, 'x')} as iqr, count(*) as n, min(x) as lo, max(x) as hi from r),
h as (select *, 0.9 * least(sd, iqr / 1.349) * power(n, -0.2) as h from s), g as (select i, lo - h + i * (hi - lo + 2 * h) / 199 as x_at, h, n from h, range(0, 200) t(i)),
f as (select x_at, sum(case when abs((x - x_at) / h) < sqrt(5.0) then 0.75 * (1 - power((x - x_at) / h, 2) / 5) / sqrt(5.0) else 0 end) / (max(n) * max(h)) as density from g, d group by x_at),
t as (select case when x_at between -4 and -1 then 'left' when x_at between 1 and 4 then 'right' end as side, x_at, ln(density) as l from f where density > 0)
select side, count(*) as n, round(regr_slope(l, x_at), 5) as slope, round(regr_intercept(l, x_at), 5) as intercept from t where side is not null group by side""", "panel")  # fmt: skip
def e10_tail_fits(spark, d):
    """Slopes of the log density of yearly log changes in both tails; the grid stays in Spark."""
    p = panel(spark, d)
    changes = pn.calendar_shift(p, ["y"], 1, "_next").select(F.ln(F.col("y_next") / F.col("y")).alias("g")).filter("g is not null")
    return rounded(ds.tail_fits(ds.kernel_density(changes, "g", 200)), 5)


@query("""with x as (select yr, y from p union all select null, y from p), o as (select *, avg(y) over (partition by yr) as mu from x)
select yr, count(*) as n, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as sd, round(avg(power(y - mu, 3)) / power(avg(power(y - mu, 2)), 1.5), 5) as skew, round(avg(power(y - mu, 4)) / power(avg(power(y - mu, 2)), 2), 5) as kurt, min(y) as min, max(y) as max from o group by yr""", "panel")  # fmt: skip
def a06_total_row_full(spark, d):
    """All statistics of the groups and of the grand total."""
    return rounded(mo.group_stats(panel(spark, d), ["yr"], "y", total=True), 4, skew=5, kurt=5)
