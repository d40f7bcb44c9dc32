"""Growth statistics of the customers' yearly order totals, with the SQL that says the same from the long panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.plans import growth as gr
from cohortlake.plans import imputation as im
from cohortlake.queries.panels import FULL_JOBS_SQL, _full_jobs
from cohortlake.queries.registry import FLOOR, aged, query, rounded
from cohortlake.queries.statistics import type2
from cohortlake.session import staged
from cohortlake.sources import readers

YEARS = range(1992, 2003)
BASES = (1997, 1998, 1999)
POINTS = (10, 50, 90)
GROUPS = 5


def tidy(df):
    """Rounded, without negative zeros."""
    out = rounded(df, 6, skew=3, kurt=3)
    return out.select(*[(F.col(c) + 0.0).alias(c) if k == "double" else c for c, k in out.dtypes])


def described_sql(source: str, keys: str, measures: str) -> str:
    """The statistics of a table x (keys, measure, g)."""
    over = f"partition by {keys}, measure"
    points = ", ".join(f"round({type2(p, 'g')}, 6) + 0.0 as p{p}" for p in POINTS)
    return f"""{source}, o as (select *, row_number() over ({over} order by g) as k, count(*) over ({over}) as n, avg(g) over ({over}) as mu from x)
select {keys}, measure, count(*) as n, round(avg(g), 6) + 0.0 as mean, round(stddev_samp(g), 6) as sd, case when max(g) > min(g) then round(avg(power(g - mu, 3)) / power(avg(power(g - mu, 2)), 1.5), 3) + 0.0 end as skew,
case when max(g) > min(g) then round(avg(power(g - mu, 4)) / power(avg(power(g - mu, 2)), 2), 3) end as kurt, round(min(g), 6) + 0.0 as min, round(max(g), 6) + 0.0 as max, {points} from o group by {keys}, measure"""


def unpivoted(table: str, keys: list[str], measures: list[str], totals: bool = True) -> str:
    """x: a row for each measure and, with totals, for each shorter list of keys."""
    levels = range(len(keys), 0, -1) if totals else [len(keys)]
    row = lambda n, m: f"select {', '.join([*keys[:n], *[f'null as {k}' for k in keys[n:]]])}, '{m}' as measure, {m} as g from {table} where {m} is not null"
    return "x as (" + " union all ".join(row(n, m) for n in levels for m in measures) + ")"


RECENT_SQL = """w as (select *, avg(greatest(y, 50000.0)) over r as re, count(case when y >= 50000 then 1 end) over r as nv from g window r as (partition by id order by yr range between 4 preceding and current row)),
s as (select w.*, w.yr + 1 as base, least(floor((w.age - 25) / 5.0) + 1, 7)::bigint as agebin, a.y as y0, b.y as y1, c.y as y2 from w left join g a on a.id = w.id and a.yr = w.yr + 1 left join g b on b.id = w.id and b.yr = w.yr + 2 left join g c on c.id = w.id and c.yr = w.yr + 3
  where w.y >= 50000 and nv >= 2 and w.age >= 25 and w.age + 2 <= 60 and w.yr + 1 between 1997 and 1999)"""


def change_sql(h: int, v: str = "y", own: str = "y", name: str = "") -> str:
    return f"""case when {own}{h} >= 50000 / 3.0 and {own}0 >= 50000 then ln({v}{h} / {v}0) - c{h} end as log{name}{h},
case when {own}{h} >= 50000 or {own}0 >= 50000 then 2 * ({v}{h} / m{h} - {v}0 / m0) / ({v}{h} / m{h} + {v}0 / m0) end as arc{name}{h}"""


def binned_sql(extra: str, value: str = "y") -> str:
    """m, v, k, q, b: means by age, residuals, ranks, cut points and groups over a table n."""
    cuts = ", ".join(f"{type2(100 * i / GROUPS, 'r')} as c{i}" for i in range(1, GROUPS))
    group = " + ".join(f"(r > q.c{i})::int" for i in range(1, GROUPS))
    means = ", ".join([f"avg({value}{k}) as m{k}" for k in (0, 1, 2)] + [f"avg(ln({value}{h} / {value}0)) as c{h}" for h in (1, 2)])
    return f"""m as (select base, age, avg(re) as mre, {means}{extra} from n group by 1, 2), v as (select n.*, m.* exclude (base, age), ln(re) - ln(mre) as r from n join m using (base, age)),
k as (select base, agebin, r, row_number() over (partition by base, agebin order by r) as k, count(*) over (partition by base, agebin) as n from v), q as (select base, agebin, {cuts} from k group by 1, 2), b as (select v.*, (1 + {group})::bigint as bin from v join q using (base, agebin))"""


def _growth_sql() -> str:
    floored = lambda k: f"case when y{k} is not null then greatest(y{k}, 50000.0) end"
    three = " + ".join(f"coalesce({floored(k)}, 0)" for k in range(3))
    source = f"""with {RECENT_SQL}, n as (select *, {floored(0)} as n1, ({three}) / 3 as n3 from s), {binned_sql(', avg(n1) as mn1, avg(n3) as mn3')},
z as (select base, agebin, bin, {change_sql(1)}, {change_sql(2)}, ln(n1) - ln(mn1) - r as next1, case when n3 > 0 then ln(n3) - ln(mn3) - r end as next3 from b), {unpivoted('z', ['base', 'agebin', 'bin'], ['log1', 'arc1', 'log2', 'arc2', 'next1', 'next3'])}"""
    return described_sql(source, "base, agebin, bin", "")


def growth(spark, d):
    return gr.growth_statistics(aged(spark, d), YEARS, BASES, FLOOR, 2, (1, 2), (1, 3), GROUPS, POINTS)


GROWTH_SQL = _growth_sql()


@query(GROWTH_SQL, "aged")
def m18_growth(spark, d):
    """Log and arc changes and coming averages by age group and recent income, with age-group and year totals."""
    return tidy(growth(spark, d))


TOTAL_SQL = """p as (select o_custkey as id, year(o_orderdate)::bigint as yr, round(sum(case when o_orderpriority <> '1-URGENT' then o_totalprice end), 2) as y, round(sum(o_totalprice), 2) as total from orders group by 1, 2),
h as (select id, yr, y, total, 1940 + id % 36 as yob, yr - (1940 + id % 36) + 1 as age from p), g as (select * from h where y is not null)"""


def _total_sql() -> str:
    recent_ = RECENT_SQL.replace("a.y as y0, b.y as y1, c.y as y2", "a.y as y0, b.y as y1, c.y as y2, a.total as total0, b.total as total1, c.total as total2").replace("left join g", "left join h")
    source = f"""with {TOTAL_SQL}, {recent_}, n as (select * from s), {binned_sql('', 'total')},
z as (select base, agebin, bin, {change_sql(1, 'total', 'y', '_total')}, {change_sql(2, 'total', 'y', '_total')} from b), {unpivoted('z', ['base', 'agebin', 'bin'], ['log_total1', 'arc_total1', 'log_total2', 'arc_total2'])}"""
    return described_sql(source, "base, agebin, bin", "")


@query(_total_sql())
def m18_total_income(spark, d):
    """Urgent orders are the income beside labour."""
    o = readers.table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    labour = F.round(F.sum(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))), 2)
    p = o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("yr")).agg(labour.alias("y"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    p = p.withColumn("yob", (1940 + F.col("id") % 36).cast("long"))
    return tidy(gr.total_income_statistics(p, YEARS, BASES, FLOOR, 2, (1, 2), GROUPS, POINTS))


@query(described_sql(f"""with e as (select distinct id, yob from g), s as (select e.id, t.base, t.base - e.yob as age, a.y as y0, b.y as y1, c.y as y2 from e cross join (values (1997), (1998), (1999)) t(base)
  left join g a on a.id = e.id and a.yr = t.base left join g b on b.id = e.id and b.yr = t.base + 1 left join g c on c.id = e.id and c.yr = t.base + 2 where t.base - e.yob between 25 and 58),
m as (select base, age, avg(y0) as m0, avg(y1) as m1, avg(y2) as m2, avg(ln(y1 / y0)) as c1, avg(ln(y2 / y0)) as c2 from s group by 1, 2), z as (select base::bigint as base, age, {change_sql(1)}, {change_sql(2)} from s join m using (base, age)), {unpivoted('z', ['base', 'age'], ['log1', 'arc1', 'log2', 'arc2'])}""", "base, age", ""), "aged")  # fmt: skip
def m18_by_age(spark, d):
    return tidy(gr.growth_by_age(aged(spark, d), YEARS, BASES, FLOOR, (1, 2), POINTS))


@query("""with w as (select *, count(case when y >= 50000 then 1 end) over (partition by id order by yr range between 4 preceding and current row) as before, count(case when y >= 50000 then 1 end) over (partition by id order by yr range between current row and 2 following) as ahead from g)
select yr as year, age, count(*) as n, round(avg(y), 4) as mean, round(avg(ln(y)), 6) as mean_log, round(stddev_samp(ln(y)), 6) as sd_log from w where age between 25 and 60 and y >= 50000 and yr between 1996 and 2000 and case when age > 26 then before else ahead end >= 3 group by 1, 2""", "aged")  # fmt: skip
def m18_dispersion(spark, d):
    return rounded(gr.income_dispersion(aged(spark, d), YEARS, range(1996, 2001), FLOOR, 3), 6, mean=4)


def _stayer_sql() -> str:
    cuts = ", ".join(f"{type2(100 * i / GROUPS, 'r')} as c{i}" for i in range(1, GROUPS))
    group = " + ".join(f"(r > q.c{i})::int" for i in range(1, GROUPS))
    test = "c.e1 = f.e1 and c.w1 / c.labor >= 0.8 and f.w1 / f.labor >= 0.8 and c.e1 in (b.e1, coalesce(b.e2, -1), coalesce(b.e3, -1)) and f.e1 in (a.e1, coalesce(a.e2, -1), coalesce(a.e3, -1)) and c.selfinc < greatest(50000.0, 0.1 * c.labor) and f.selfinc < greatest(50000.0, 0.1 * f.labor)"
    source = f"""with {FULL_JOBS_SQL}, p as (select id, yr, labor as y from e), g as (select id, yr, y, 1940 + id % 36 as yob, yr - (1940 + id % 36) + 1 as age from p), {RECENT_SQL},
pr as (select age, avg(y) as dummy from g where age between 25 and 60 group by 1), sp as (select age, ln(avg(dummy) over (order by age range between 4 preceding and current row)) as profile from pr),
v as (select s.*, ln(re) - profile as r, least(greatest(floor((s.age - 26) / 5.0) + 1, 1), 7)::bigint as five from s join sp using (age)),
k as (select base, five, r, row_number() over (partition by base, five order by r) as k, count(*) over (partition by base, five) as n from v), q as (select base, five, {cuts} from k group by 1, 2),
bb as (select v.*, (1 + {group})::bigint as bin from v join q using (base, five)), kinds as (select c.id, c.yr as base, coalesce({test}, false)::int::bigint as stay from e c join e f on f.id = c.id and f.yr = c.yr + 1 left join e b on b.id = c.id and b.yr = c.yr - 1 left join e a on a.id = c.id and a.yr = c.yr + 2),
ch as (select bb.base, bb.age, bin, stay, case when bb.age <= 35 then 1 when bb.age <= 45 then 2 when bb.age <= 55 then 3 end::bigint as agebin, ln(y1 / d2.dummy) - ln(y0 / d1.dummy) as change from bb join kinds using (id, base) join pr d1 on d1.age = bb.age + 1 join pr d2 on d2.age = bb.age + 2 where y0 >= 50000 and y1 >= 50000 and bb.age <= 55),
x as (select base, agebin, bin, stay, 'log1' as measure, change - avg(change) over (partition by base, age) as g from ch)"""
    return described_sql(source, "base, agebin, bin, stay", "")


@query(_stayer_sql())
def m18_stayers(spark, d):
    """Labour income and employers from the line items, the last of four suppliers' groups being self-employment."""
    jobs = staged(_full_jobs(spark, d), "jobs")  # the panel, its profile and the pairs of years all come from them
    p = jobs.select("id", "yr", F.col("labor").alias("y"), (1940 + F.col("id") % 36).cast("long").alias("yob")).withColumn("age", F.col("yr") - F.col("yob") + 1)
    return tidy(gr.stayer_statistics(p, jobs, YEARS, BASES, FLOOR, 2, "IIv2", GROUPS, POINTS))


# --- imputation: urgent orders are self-employment income, the others wages

FLOORS = {t: 30000.0 + 1000 * (t - 1992) for t in range(1992, 2003)}
CAPS = {t: 100000.0 + 5000 * (t - 1992) for t in range(1992, 2003)}
IMPUTED_YEARS = (1998, 1999, 2000)
FIT_YEAR = 1999
TRIAL_SLOTS = 4


def _workers(spark, d):
    o = readers.table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    kind = lambda urgent: F.round(F.sum(F.when((F.col("o_orderpriority") == "1-URGENT") == urgent, F.col("o_totalprice"))), 2)
    p = o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("yr")).agg(kind(False).alias("wage"), kind(True).alias("selfinc"))
    return gr.person_arrays(p.withColumn("yob", (1940 + F.col("id") % 36).cast("long")), YEARS, ("wage", "selfinc"))


def _trial_value(agebin: str, slot: str, j: int) -> str:
    return f"((({agebin} * 31 + {slot} * 17 + {j} * 7) % 11) - 5) / 100.0" if j else f"11.0 + {agebin} * 0.05 + {slot} * 0.2"


def _imputation_sql() -> str:
    floor, cap = (lambda t: f"({30000} + 1000 * ({t} - 1992))"), (lambda t: f"({100000} + 5000 * ({t} - 1992))")
    at = lambda v, k: f"coalesce(l{k}.{v}, 0)" if k else f"coalesce(c.{v}, 0)"
    year = lambda k: f"(c.yr - {k})"
    zero = lambda v, k: f"({at(v, k)} < {floor(year(k))})::int"
    log = lambda v, k: f"case when {at(v, k)} >= {floor(year(k))} then ln({at(v, k)}) else 0 end"
    terms = [f(v, k) for f, v, ks in ((zero, "wage", (3, 2, 1, 0)), (log, "wage", (3, 2, 1, 0))) for k in ks] + [f"({at('selfinc', k)} >= {cap(year(k))})::int" for k in (3, 2, 1)]
    terms += [zero("selfinc", k) for k in (3, 2, 1)] + [f"least({log('selfinc', k)}, ln({cap(year(k))}))" for k in (3, 2, 1)]
    dot = " + ".join([_trial_value("agebin", "slot", 0), *[f"({_trial_value('agebin', 'slot', j)}) * ({t})" for j, t in enumerate(terms, 1)]])
    joins = " ".join(f"left join w l{k} on l{k}.id = c.id and l{k}.yr = c.yr - {k}" for k in (3, 2, 1))
    return f"""with w as (select o_custkey as id, year(o_orderdate)::bigint as yr, round(sum(case when o_orderpriority <> '1-URGENT' then o_totalprice end), 2) as wage, round(sum(case when o_orderpriority = '1-URGENT' then o_totalprice end), 2) as selfinc from orders group by 1, 2),
c as (select *, yr - (1940 + id % 36) + 1 as age, least((yr - (1940 + id % 36) + 1 - 25) // 5 + 1, 7) as agebin, floor(('0x' || substr(md5('slot:' || id), 1, 12))::bigint / 281474976710656.0 * {TRIAL_SLOTS}) as slot from w where selfinc is not null and yr between 1998 and 2000),
x as (select c.id, c.yr, c.selfinc, {dot} as s from c {joins} where c.age between 25 and 60)
select id, yr, round(selfinc, 2) as selfinc, round(case when selfinc > {cap("yr")} then greatest(selfinc, exp(s) * {cap("yr")} / {CAPS[FIT_YEAR]}) else selfinc end, 2) as imputed from x"""


@query(_imputation_sql())
def e06_year_shifted(spark, d):
    """Shifted features, slots and scaling under coefficients that a rule gives."""
    grid = spark.range(1, 8).select(F.col("id").alias("agebin"), F.explode(F.sequence(F.lit(0), F.lit(TRIAL_SLOTS - 1))).alias("slot"))
    columns = ["b0", *[f"b_{n}" for n in im.names()]]
    trial = grid.select("agebin", F.col("slot").cast("double").alias("q"), *[F.expr(f"cast({_trial_value('agebin', 'slot', j)} as double)").alias(c) for j, c in enumerate(columns)])
    return rounded(im.imputed_incomes(_workers(spark, d), trial, YEARS[0], IMPUTED_YEARS, FIT_YEAR, FLOORS, CAPS), 2)


@query()
def e06_imputed_incomes(spark, d):
    """Coefficients fitted on the data by quantile regressions of seventeen features, then applied to other years."""
    people = _workers(spark, d)
    coefficients = im.imputation_coefficients(people, YEARS[0], FIT_YEAR, FLOORS, CAPS, TRIAL_SLOTS)
    return rounded(im.imputed_incomes(people, coefficients, YEARS[0], IMPUTED_YEARS, FIT_YEAR, FLOORS, CAPS), 2)
