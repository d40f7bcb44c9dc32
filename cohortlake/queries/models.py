"""Pipelines, simulation, moments, objective and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu
from cohortlake.functions.scalar import arc_change
from cohortlake.operators import panel as pn
from cohortlake.operators import reshape as rs
from cohortlake.plans import objective as ob
from cohortlake.plans import panel_moments as pm
from cohortlake.plans import pipelines as pl
from cohortlake.plans import search as se
from cohortlake.plans import simulation as si
from cohortlake.queries.registry import FLOOR, aged, panel, query, rounded
from cohortlake.queries.statistics import type2

RE = (1, 6, 11, 31, 51, 71, 91, 96, 101)
PLACE = "case " + " ".join(f"when k < floor(n * {e - 1} / 100) then {j}" for j, e in enumerate(RE[1:], 1)) + " else 8 end"
RECENT = """re as (select id, yr, y, avg(greatest(y, 50000.0)) over x as r, count(case when y >= 50000.0 then 1 end) over x as nv from p window x as (partition by id order by yr range between 4 preceding and current row)),
ok as (select id, yr, y, r from re where y >= 50000.0 and nv >= 2), rk as (select *, row_number() over (partition by yr order by r, id) - 1 as k, count(*) over (partition by yr) as n from ok), bin as (select id, yr, y, """ + PLACE + """ as b from rk)"""


@query(f"""with {RECENT}, mu as (select yr, avg(y) as d from p group by yr), g as (select b.b, 2 * (f.y / mf.d - c.y / mc.d) / (f.y / mf.d + c.y / mc.d) as g from bin b join p c on c.id = b.id and c.yr = b.yr + 1 join p f on f.id = b.id and f.yr = b.yr + 2 join mu mc on mc.yr = c.yr join mu mf on mf.yr = f.yr),
c as (select b, avg(g) as m from g group by b) select g.b::bigint as re_bin, count(*) as n, round(avg(g.g), 6) as mean, round(stddev_samp(g.g), 6) as sd, round(avg(power(g.g - c.m, 3)) / power(avg(power(g.g - c.m, 2)), 1.5), 5) as skew, round(avg(power(g.g - c.m, 4)) / power(avg(power(g.g - c.m, 2)), 2), 5) as kurt
from g join c on c.b = g.b group by g.b""", "panel")  # fmt: skip
def m00_change_by_recent_income(spark, d):
    """Changes from t to t + 1 by recent income over t-5..t-1."""
    p = panel(spark, d)
    means = p.groupBy("yr").agg(F.avg("y").alias("mean"))
    changed = pn.calendar_shift(pn.arc_changes(pn.recent_income(p, "y", FLOOR, 5, 2), "y", 1, "g", means), ["g"], 1, "_next")
    binned = qu.rank_bins(changed.filter("re is not null"), ["yr"], ["re", "id"], RE, "re_bin").filter("g_next is not null")
    return rounded(mo.group_stats(binned, ["re_bin"], "g_next", extremes=False), 6, skew=5, kurt=5)


# --- simulation and moments of simulated panels


def _simulated(spark, n=2000):
    return si.simulated(si.shock_rows(spark, n).repartition(spark.sparkContext.defaultParallelism)).persist()


@query()
def m01_shocks(spark, d):
    return si.shock_rows(spark, 2000).select("id", "hip1", "hip2", "z0", F.size("eta").alias("steps"))


@query()
def m02_simulate(spark, d):
    return si.simulated(si.shock_rows(spark, 2000))


@query()
def m03_simulate_many(spark, d):
    thetas = [(i, (si.TRUTH * (1 + 0.01 * i)).tolist()) for i in range(4)]
    found = si.simulated_for(spark.createDataFrame(thetas, "i long, x array<double>").repartition(4), 500)
    return found.groupBy("i").agg(F.count("*").alias("n"), F.round(F.avg(F.aggregate("y", F.lit(0.0), lambda a, v: a + v)), 6).alias("mean_total"))


@query()
def m05_ordinal_transform(spark, d):
    from cohortlake.plans import transforms as tr

    model = rs.matrix_to_long(si.simulated(si.shock_rows(spark, 500))).filter("age between 25 and 30")
    drawn = panel(spark, d).select("y")
    return rounded(tr.ordinal_transform(model, drawn, ["age"], "y", "y"), 4)


@query()
def m06_toolbox_panel(spark, d):
    return rs.toolbox_panel(si.simulated(si.shock_rows(spark, 500)), 1970)


@query()
def m07_longdata_sim(spark, d):
    y = _simulated(spark)
    return rounded(pm.long_panel(y, pm._values(pm.age_profile(y))))


@query()
def m08_cross_section(spark, d):
    y = _simulated(spark)
    return rounded(pm.cross_section(pm.long_panel(y, pm._values(pm.age_profile(y)))))


@query()
def m09_impulse(spark, d):
    y = _simulated(spark)
    return rounded(pm.impulses(pm.long_panel(y, pm._values(pm.age_profile(y)))))


@query()
def m10_lifetime_ecdf(spark, d):
    growth, employed = pm.lifetime(_simulated(spark))
    return rounded(growth.unionByName(employed))


@query("""with w as (select id, yr, y, lead(y) over (partition by id order by yr) as y1, row_number() over (partition by yr order by y, id) as k, count(*) over (partition by yr) as n from p)
select yr, count(*) as n, round(max(case when k = least(n, floor(n * 0.5) + 1) then y end), 2) as p50, round(sum(case when k >= floor(round(n * 0.9, 9)) + 1 then y else 0 end) / sum(y), 6) as top10, round(avg((y < 50000)::int), 6) as low, round(avg(case when y1 > y then 1.0 else 0.0 end), 6) as up from w group by yr""", "panel")  # fmt: skip
def m11_diagnostics(spark, d):
    p = pn.shifted(panel(spark, d), "y", -1, "y1")
    r, y = qu.ranked(p, ["yr"], ["y", "id"]), F.col("y")
    top = F.sum(F.when(F.col("_k") >= F.floor(F.round(F.col("_n") * 0.9, 9)) + 1, y).otherwise(0.0)) / F.sum(y)
    return rounded(r.groupBy("yr").agg(F.count("*").alias("n"), qu.percentile(y, 50, "floor").alias("p50"), top.alias("top10"), F.avg((y < FLOOR).cast("int")).alias("low"), F.avg(F.when(F.col("y1") > y, 1.0).otherwise(0.0)).alias("up")), 6, p50=2)


def _toolbox_frame(spark, d):
    g = aged(spark, d)
    return g.select(F.col("id").alias("ID"), F.col("y").alias("REAL_WAGE"), F.when(F.col("y") >= FLOOR, F.ln("y")).alias("LOG_WAGE"), F.col("yr").alias("YEAR"), F.col("age").alias("AGE"), F.col("yob").alias("COHORT"), (F.col("id") % 2).alias("SEX"))


@query(f"""with x as (select id as i, y, case when y >= 50000 then ln(y) end as l, age, yob, id % 2 as sex from g), r as (select *, row_number() over z as k, count(*) over (partition by yob, age, sex) as n, avg(l) over (partition by yob, age, sex) as mu from x window z as (partition by yob, age, sex order by y))
select yob as "COHORT", age as "AGE", sex as "SEX", count(*) as n, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as sd, round(avg(l), 6) as mean_log, round(stddev_samp(l), 6) as sd_log,
case when count(l) > 2 and max(l) > min(l) then round(avg(power(l - mu, 3)) / power(avg(power(l - mu, 2)), 1.5) * sqrt(count(l) * (count(l) - 1.0)) / (count(l) - 2.0), 3) + 0.0 end as skew_log,
case when count(l) > 3 and max(l) > min(l) then round(((count(l) + 1.0) * (avg(power(l - mu, 4)) / power(avg(power(l - mu, 2)), 2) - 3) + 6) * (count(l) - 1.0) / ((count(l) - 2.0) * (count(l) - 3.0)), 3) + 0.0 end as kurt_log, {', '.join(f'round(max(case when k = greatest(ceil(round(n * {p} / 100, 9)), 1) then y end), 4) as p{p}' for p in (10, 25, 50, 75, 90, 98))} from r group by 1, 2, 3""", "aged")  # fmt: skip
def m12_toolbox(spark, d):
    """All cohorts, ages and sexes of the panel."""
    out = rounded(pl.toolbox(_toolbox_frame(spark, d), range(1940, 1976), range(20, 70), [0, 1]), 4, mean_log=6, sd_log=6, skew_log=3, kurt_log=3)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c) + 0.0) for c in ("skew_log", "kurt_log")})


@query("""with a as (select id, age, yob, id % 2 as sex, 200 * (y - lag(y, 1) over w) / (y + lag(y, 1) over w) as a1, 200 * (y - lag(y, 5) over w) / (y + lag(y, 5) over w) as a5 from g window w as (partition by id order by yr)), u as (select yob, age, sex, 1 as h, a1 as arc from a union all select yob, age, sex, 5, a5 from a)
select yob as "COHORT", age as "AGE", sex as "SEX", h::int as h, count(arc) as n, round(case when count(arc) >= 3 then stddev_samp(arc) end, 4) as sd from u group by 1, 2, 3, 4""", "aged")  # fmt: skip
def m12_toolbox_changes(spark, d):
    return rounded(pl.toolbox_changes(_toolbox_frame(spark, d)).drop("skew", "kurt"), 4)


@query("""with a as (select id, age, yob, id % 2 as sex, 200 * (y - lag(y, 1) over w) / (y + lag(y, 1) over w) as a1, 200 * (y - lag(y, 5) over w) / (y + lag(y, 5) over w) as a5 from g window w as (partition by id order by yr)), u as (select yob, age, sex, 1 as h, a1 as arc from a union all select yob, age, sex, 5, a5 from a),
o as (select *, avg(arc) over z as mu, count(arc) over z as n from u window z as (partition by yob, age, sex, h)), m as (select yob, age, sex, h, max(n) as n, stddev_samp(arc) as sd, avg(power(arc - mu, 2)) as m2, avg(power(arc - mu, 3)) as m3, avg(power(arc - mu, 4)) as m4 from o group by 1, 2, 3, 4)
select yob as "COHORT", age as "AGE", sex as "SEX", h::int as h, n, round(case when n >= 3 then sd end, 4) as sd, case when n >= 3 and m2 > 0 then round(m3 / power(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2.0), 3) + 0.0 end as skew, case when n > 3 and m2 > 0 then round(((n + 1.0) * (m4 / power(m2, 2) - 3) + 6) * (n - 1.0) / ((n - 2.0) * (n - 3.0)) + 3, 3) end as kurt from m""", "aged")  # fmt: skip
def m12_toolbox_changes_full(spark, d):
    """With skewness and kurtosis."""
    out = rounded(pl.toolbox_changes(_toolbox_frame(spark, d)), 4, skew=3, kurt=3)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c) + 0.0) for c in ("skew", "kurt")})


@query("""with e as (select id, avg(greatest(y, 50000.0)) as lt, count(case when y >= 50000 then 1 end) as emp from p group by id having count(case when y >= 50000 then 1 end) >= 3), r as (select id, row_number() over (order by lt, id) - 1 as k, count(*) over () as n from e),
b as (select id, (case when k < floor(n * 25 / 100) then 1 when k < floor(n * 50 / 100) then 2 when k < floor(n * 75 / 100) then 3 else 4 end)::bigint as le_group from r) select le_group, age, count(*) as n, round(avg(greatest(y, 50000.0)), 4) as mean from g join b using (id) where age in (25, 30, 35, 40, 45, 50, 55, 60) group by 1, 2""", "aged")  # fmt: skip
def m14_profile(spark, d):
    return rounded(pl.lifecycle_profile(aged(spark, d), (1, 26, 51, 76, 101), [25, 30, 35, 40, 45, 50, 55, 60], FLOOR, 3), 4)


@query("""with m as (select age, avg(y) as m from g group by age), q as (select g.id, g.yr, g.y, g.age, g.y / m as v from g join m using (age)), c as (select a.age, 2 * (b.v - a.v) / (b.v + a.v) as g from q a join q b on b.id = a.id and b.yr = a.yr + 1)
select age, count(*) as n, round(stddev_pop(g), 6) as sd from c group by age""", "aged")  # fmt: skip
def m15_six_panel(spark, d):
    g = aged(spark, d)
    means = g.groupBy("age").agg(F.avg("y").alias("m"))
    v = g.join(F.broadcast(means), "age").withColumn("v", F.col("y") / F.col("m"))
    c = pn.calendar_shift(v, ["v"], 1, "_n").withColumn("g", arc_change(F.col("v_n"), F.col("v"))).filter("g is not null")
    return rounded(c.groupBy("age").agg(F.count("*").alias("n"), mo.population(F.col("g"))["sd"].alias("sd")))


@query("""with m as (select age, avg(y) as m from g group by age), q as (select g.id, g.yr, g.age, g.y / m as v from g join m using (age)),
c as (select hs.h, a.age, 2 * (b.v - a.v) / (b.v + a.v) as g from (values (1), (5)) hs(h), q a join q b on b.id = a.id where b.yr = a.yr + hs.h), mu as (select h, age, avg(g) as mu from c group by 1, 2)
select h::bigint as h, age, count(*) as n, round(stddev_pop(g), 6) as sd, round(avg(power(g - mu, 3)) / power(avg(power(g - mu, 2)), 1.5), 4) + 0.0 as skew, round(avg(power(g - mu, 4)) / power(avg(power(g - mu, 2)), 2), 4) as kurt from c join mu using (h, age) group by 1, 2 having count(*) >= 3""", "aged")  # fmt: skip
def m15_six_panel_shape(spark, d):
    """Standard deviation, skewness and kurtosis of one- and five-year changes by age."""
    out = rounded(pl.age_changes(aged(spark, d)), 6, skew=4, kurt=4)
    return out.withColumn("skew", F.col("skew") + 0.0)  # no negative zero


IMPULSE_EDGES = ((20, 60, 100), (30, 70, 100))


def _impulse_sql(centre: str) -> str:
    """Impulse responses with 10 fine groups, in three income and four shock groups."""
    cuts = lambda v: ", ".join(f"{type2(10 * i, v)} as c{i}" for i in range(1, 10))
    fine = lambda v: "10 * (1 + " + " + ".join(f"({v} > c{i})::int" for i in range(1, 10)) + ")"
    group = lambda x, edges: f"(1 + ({x} > {edges[0]})::int + ({x} > {edges[1]})::int)"
    values = ("y", "y0", "y1", "y2")
    # the median of an even number of values is the mean of the middle two
    centres = ", ".join(f"{'avg' if centre == 'mean' else 'median'}({v}) as m_{v}" for v in values)
    arc = lambda a, b: f"2 * ({a} / m_{a} - {b} / m_{b}) / ({a} / m_{a} + {b} / m_{b})"
    return f"""with w as (select *, avg(greatest(y, 50000.0)) over x as re, count(case when y >= 50000 then 1 end) over x as nv from g window x as (partition by id order by yr range between 4 preceding and current row)),
am as (select age, avg(y) as m from g group by age), tr as (select age, ln(avg(m) over (order by age range between 4 preceding and current row)) as profile from am),
s as (select w.id, w.yr, w.age, w.y, b.y as y0, c.y as y1, e.y as y2, ln(w.re) - profile as residual, case when w.age <= 34 then 1 else 2 end as agebin from w join tr using (age) left join g b on b.id = w.id and b.yr = w.yr + 1 left join g c on c.id = w.id and c.yr = w.yr + 2 left join g e on e.id = w.id and e.yr = w.yr + 3 where w.y >= 50000 and nv >= 2 and w.age between 25 and 58 and w.yr + 1 between 1997 and 1999),
ce as (select yr, age, {centres} from s group by 1, 2), v as (select s.*, {arc("y0", "y")} as shock, {arc("y1", "y")} as f1, {arc("y2", "y")} as f2 from s join ce using (yr, age)),
k as (select *, row_number() over (partition by yr, agebin order by residual) as k, count(*) over (partition by yr, agebin) as n from v), q as (select yr, agebin, {cuts("residual")} from k group by 1, 2),
b as (select v.*, {group(fine("residual"), IMPULSE_EDGES[0])} as inc from v join q using (yr, agebin) where shock is not null),
k2 as (select *, row_number() over (partition by agebin, inc order by shock) as k, count(*) over (partition by agebin, inc) as n from b where shock > -1.99), q2 as (select agebin, inc, {cuts("shock")} from k2 group by 1, 2),
h as (select b.*, case when shock <= -1.99 then 1 else 1 + {group(fine("shock"), IMPULSE_EDGES[1])} end as chg from b left join q2 using (agebin, inc))
select agebin::bigint as agebin, inc::bigint as inc, chg::bigint as chg, count(*) as n, round(avg(shock), 6) as impact, round(avg(f1), 6) as f1, round(avg(f2), 6) as f2, round(min(shock), 6) as min, round(max(shock), 6) as max from h group by 1, 2, 3"""


def _impulse(spark, d, centre):
    return rounded(pl.impulse_statistics(aged(spark, d), range(1997, 2000), FLOOR, *IMPULSE_EDGES, horizons=(1, 2), least=2, centre=centre, fine=10))


@query(_impulse_sql("mean"), "aged")
def m16_impulse_quantile(spark, d):
    return _impulse(spark, d, "mean")


@query(_impulse_sql("median"), "aged")
def m16_impulse_median(spark, d):
    return _impulse(spark, d, "median")


@query()
def m16_impulse_full(spark, d):
    """All 2 x 8 x 23 cells and five horizons."""
    return rounded(pl.impulse_statistics(aged(spark, d), range(1997, 2002), FLOOR, least=2))


@query("select a.age, count(*) as n, round(ln(avg(b.y)) - ln(avg(a.y)), 6) as rep from g a join g b on b.id = a.id and b.yr = a.yr + 2 group by a.age", "aged")
def m17_rep_agent(spark, d):
    return rounded(pl.representative_changes(aged(spark, d), ["age"], 2))


def _cross_sql(measure: str) -> str:
    cuts = ", ".join(f"{type2(20 * i, 'r')} as c{i}" for i in range(1, 5))
    change = {
        "arc": "case when y1 >= 50000 or y0 >= 50000 then 2 * (y1 / m1 - y0 / m0) / (y1 / m1 + y0 / m0) end",
        "log": "case when y1 >= 50000 / 3.0 and y0 >= 50000 then ln(y1 / y0) - ml end",
    }[measure]
    points = ", ".join(f"{type2(p, 'g')} as p{p}" for p in (10, 50, 90))
    means = ", ".join(f"round(avg({c}), 6) as {c}" for c in ("n", "mean", "sd", "min", "max", "p10", "p50", "p90"))
    return f"""with w as (select *, avg(greatest(y, 50000.0)) over x as re, count(case when y >= 50000 then 1 end) over x as nv from g window x as (partition by id order by yr range between 4 preceding and current row)),
s as (select w.id, w.yr, w.age, w.re, b.y as y0, f.y as y1, least(floor((w.age - 25) / 5.0) + 1, 7) as agebin from w left join g b on b.id = w.id and b.yr = w.yr + 1 left join g f on f.id = w.id and f.yr = w.yr + 2 where w.y >= 50000 and nv >= 2 and w.age between 25 and 58 and w.yr + 1 in (1997, 1998, 1999)),
m as (select yr, age, avg(re) as mre, avg(y0) as m0, avg(y1) as m1, avg(ln(y1 / y0)) as ml from s group by 1, 2), v as (select s.*, ln(re) - ln(mre) as r, {change} as g from s join m using (yr, age)),
k as (select *, row_number() over (partition by yr, agebin order by r) as k, count(*) over (partition by yr, agebin) as n from v), q as (select yr, agebin, {cuts} from k group by 1, 2), b as (select v.*, 1 + (r > c1)::int + (r > c2)::int + (r > c3)::int + (r > c4)::int as bin from v join q using (yr, agebin)),
o as (select yr, agebin, bin, g, row_number() over z as k, count(*) over (partition by yr, agebin, bin) as n, avg(g) over (partition by yr, agebin, bin) as mu from b where g is not null window z as (partition by yr, agebin, bin order by g)),
t as (select yr, agebin, bin, count(*) as n, avg(g) as mean, stddev_samp(g) as sd, case when max(g) > min(g) then avg(power(g - mu, 3)) / power(avg(power(g - mu, 2)), 1.5) end as skew, case when max(g) > min(g) then avg(power(g - mu, 4)) / power(avg(power(g - mu, 2)), 2) end as kurt, min(g) as min, max(g) as max, {points} from o group by 1, 2, 3)
select 1::bigint as horizon, agebin::bigint as agebin, bin::bigint as bin, {means}, round(avg(skew), 4) + 0.0 as skew, round(avg(kurt), 4) as kurt from t group by 2, 3"""


def _cross(spark, d, measure):
    out = rounded(pl.change_statistics(aged(spark, d), [1997, 1998, 1999], (1,), FLOOR, 2, 5, measure, (10, 50, 90)), 6, skew=4, kurt=4)
    return out.withColumn("skew", F.col("skew") + 0.0)  # no negative zero


@query(_cross_sql("arc"), "aged")
def m18_cross_pipeline(spark, d):
    return _cross(spark, d, "arc")


@query(_cross_sql("log"), "aged")
def m18_cross_log(spark, d):
    return _cross(spark, d, "log")


@query("""with t as (select 'm' as grp, yr as i, avg(y) as m from p group by yr), d as (select yr as i, avg(y) * 1.1 + yr % 3 as d from p group by yr), q as (select quantile_cont(abs(m), 0.1) as psi, count(*) as size from t) select grp, i, round(m, 4) as value, round(d, 4) as d, round((d - m) / ((abs(d) + abs(m)) / 2 + psi), 6) as f, round(1.0 / size, 8) as w from t join d using (i), q""", "panel")
def m19_deviation(spark, d):
    zero = F.lit(0).cast("long")
    means = panel(spark, d).groupBy(F.col("yr").alias("i")).agg(F.avg("y").alias("value")).select(F.lit("m").alias("grp"), "i", zero.alias("j"), zero.alias("k"), zero.alias("l"), "value")
    targets = ob.weighted_targets(means, {"m": 1.0})
    moved = means.withColumn("value", F.col("value") * 1.1 + F.col("i") % 3)
    return rounded(ob.deviations(moved, targets).select("grp", "i", "value", "d", "f", "w"), 4, f=6, w=8)


@query()
def m20_objective(spark, d):
    y = _simulated(spark)
    found = pm.all_moments(y)
    targets = ob.weighted_targets(found.withColumn("value", F.col("value") * 1.01))
    return rounded(ob.objective_value(found, targets))


def _problem() -> ob.Problem:
    return ob.Problem.synthetic(["a1", "rho1"], 300)


@query()
def m22_sobol_screen(spark, d):
    problem = _problem()
    return rounded(ob.evaluated(se.sobol_points(spark, 32, problem.bounds).repartition(8), problem))


@query()
def m23_starts(spark, d):
    problem = _problem()
    return rounded(se.starts(ob.evaluated(se.sobol_points(spark, 32, problem.bounds).repartition(8), problem), 4))


@query()
def m25_local_search(spark, d):
    problem = _problem()
    found = se.refined(spark.createDataFrame([(0, [0.7, 0.9]), (1, [1.2, 0.95])], "i long, x array<double>").repartition(2), problem, problem.bounds, 30)
    return rounded(found)


@query()
def m28_slices(spark, d):
    problem = _problem()
    return rounded(se.objective_slices(spark, problem, [si.TRUTH[1], si.TRUTH[6]], problem.free, problem.bounds, 5))


@query()
def m29_parametric_bootstrap(spark, d):
    from cohortlake.plans import transforms as tr

    return rounded(tr.bootstrap_moments(spark, si.TRUTH, 300, 4))


@query("with a as (select yr, avg(y) as x from p group by yr), b as (select yr, median(y) as z from p group by yr) select round(max(abs(x - z)), 4) as max_diff, round(avg(abs(x - z)), 4) as mean_diff, round(corr(x, z), 6) as r from a join b using (yr)", "panel")
def m30_comparison(spark, d):
    from cohortlake.plans import transforms as tr

    p = panel(spark, d)
    a, b = p.groupBy("yr").agg(F.avg("y").alias("v")), p.groupBy("yr").agg(F.percentile("y", 0.5).alias("v"))
    return rounded(tr.compared(a, b, ["yr"], "v"), 4, r=6)




@query()
def m04_cohorts(spark, d):
    from cohortlake.plans import cohorts

    start = cohorts.first_year(spark.range(500).select("id", (1940 + F.col("id") % 36).alias("cohort")))
    return rounded(cohorts.projected(cohorts.projected(start)).groupBy("age").agg(F.count("*").alias("n"), F.avg("income").alias("mean")))


def _toolbox_impulse_sql(incomes: int = 4, shocks: int = 5, horizons: tuple[int, ...] = (1, 2)) -> str:
    place = lambda p: f"(round((n - 1) * {p} / 100, 9) + 1)"
    between = lambda v, p: f"sum(case when k = floor({place(p)}) then {v} * (1 - ({place(p)} - floor({place(p)}))) when k = floor({place(p)}) + 1 then {v} * ({place(p)} - floor({place(p)})) end)"
    cuts = lambda v, k: ", ".join(f"{between(v, 100 * i / k)} as c{i}" for i in range(1, k))
    ranked = lambda t, v, by: f"(select *, row_number() over (partition by {by} order by {v}) as k, count({v}) over (partition by {by}) as n from {t} where {v} is not null)"
    group = lambda v, k: "1 + " + " + ".join(f"({v} > c{i})::int" for i in range(1, k))
    arc = lambda a, b: f"200 * ({a} - {b}) / ({a} + {b})"
    leads = ", ".join(f"{arc(f'lead(y, {h}) over w', 'y')} as g{h}" for h in horizons)
    long = " union all ".join(f"select age_group, inc, chg, {h} as h, g{h} as g from k" for h in horizons)
    return f"""with f as (select id, age, avg(greatest(y, 50000.0)) over (partition by id order by yr rows between 4 preceding and current row) as re, {arc("y", "lag(y) over w")} as past, {leads} from g window w as (partition by id order by yr)),
s as (select *, case when age <= 34 then 1 else 2 end as age_group from f where past is not null), c as (select age_group, {cuts("re", incomes)} from {ranked("s", "re", "age_group")} group by 1), b as (select s.*, {group("re", incomes)} as inc from s join c using (age_group)),
e as (select age_group, inc, {cuts("past", shocks)} from {ranked("b", "past", "age_group, inc")} group by 1, 2), k as (select b.*, {group("past", shocks)} as chg from b join e using (age_group, inc)), u as ({long})
select age_group::bigint as age_group, inc::bigint as inc, chg::bigint as chg, h::bigint as h, count(g) as n, round(avg(g), 4) as response from u group by 1, 2, 3, 4"""


@query(_toolbox_impulse_sql(), "aged")
def m13_toolbox_impulse(spark, d):
    return rounded(pl.toolbox_impulse(_toolbox_frame(spark, d), (1, 2), FLOOR, income_groups=4, shock_groups=5), 4)


@query(_toolbox_impulse_sql(8, 23, (1, 2, 3, 5, 10)), "aged")
def m13_toolbox_impulse_full(spark, d):
    """All 2 x 8 x 23 cells and five horizons."""
    return rounded(pl.toolbox_impulse(_toolbox_frame(spark, d), (1, 2, 3, 5, 10), FLOOR), 4)


#: First percentiles of the fifteen groups of lifetime income, and the end.
LIFETIME_EDGES = (1, 2, 6, 11, 21, 31, 41, 51, 61, 71, 81, 91, 96, 98, 100, 101)


@query(f"""with e as (select id, avg(greatest(y, 50000.0)) as lt, count(case when y >= 50000 then 1 end) as emp from p group by id having count(case when y >= 50000 then 1 end) >= 3), r as (select id, row_number() over (order by lt, id) - 1 as k, count(*) over () as n from e),
b as (select id, (case {" ".join(f"when k < floor(round(n * {e - 1} / 100, 9)) then {j}" for j, e in enumerate(LIFETIME_EDGES[1:-1], 1))} else 15 end)::bigint as le_group from r) select le_group, age, count(*) as n, round(avg(greatest(y, 50000.0)), 4) as mean from g join b using (id) where age in (25, 30, 35, 40, 45, 50, 55, 60) group by 1, 2""", "aged")  # fmt: skip
def m14_profile_full(spark, d):
    """Fifteen groups of lifetime income by eight ages."""
    return rounded(pl.lifecycle_profile(aged(spark, d), LIFETIME_EDGES, [25, 30, 35, 40, 45, 50, 55, 60], FLOOR, 3), 4)


@query()
def m24_blended_search(spark, d):
    problem = _problem()
    found = se.minimise(spark, problem, problem.bounds, draws=32, keep=2, maxiter=30, batch=2)
    return rounded(se.recovery(spark, problem.free, found["x"], si.TRUTH[[1, 6]]), 4)


@query()
def e02_survey_changes(spark, d):
    from cohortlake.plans import survey

    g = aged(spark, d).filter("age between 25 and 60").select(F.col("id").alias("person"), F.col("yr").alias("year"), F.col("y").alias("real"), "age", (F.col("id") % 4).alias("kind"))
    return rounded(survey.robust_statistics(survey.change_groups(g, ["age", "kind"]), ["year"]), 5)
