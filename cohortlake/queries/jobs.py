"""The runnable jobs as queries: each is run twice into one new folder of the shared directory, and its whole output is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlake.queries.growth import GROWTH_SQL, tidy
from cohortlake.queries.registry import query, rounded
from cohortlake.queries.statistics import type2
from jobs import growth_report, text_profile

LOCAL_FOLDER = "/tmp/checkpoints/cohortlake"


def _folder(spark, name: str) -> str:
    """A new path that stays; a cluster must name the shared directory."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or LOCAL_FOLDER).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(GROWTH_SQL, "aged")
def job1_growth_report(spark, d):
    """The yearly growth report, run over all base years and then again."""
    target, config = _folder(spark, "growth-report"), growth_report.settings()
    growth_report.run(spark, d, target, config)
    return tidy(growth_report.run(spark, d, target, config))


def _profile_sql() -> str:
    points = ", ".join(f"round({type2(p, 'w')}, 6) as p{p}" for p in (10, 50, 90, 99))
    return rf"""with d as (select source, lang, length(coalesce(text, ''))::bigint as chars, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::bigint as words from documents),
e as (select source, lang, count(*) as n, sum(words)::bigint as n_words, sum(chars)::bigint as n_chars from d group by 1, 2),
k as (select source, lang, words::double as w, ln(words) as l, row_number() over z as k, count(*) over (partition by source, lang) as n, avg(ln(words)) over (partition by source, lang) as mu from d where words > 0 window z as (partition by source, lang order by words)),
s as (select source, lang, round(avg(l), 6) as mean_log, round(stddev_samp(l), 6) as sd_log, case when max(l) > min(l) then round(avg(power(l - mu, 3)) / power(avg(power(l - mu, 2)), 1.5), 3) + 0.0 end as skew_log, case when max(l) > min(l) then round(avg(power(l - mu, 4)) / power(avg(power(l - mu, 2)), 2), 3) end as kurt_log,
  {points}, round(sum(case when k >= floor(round(n * 0.9, 9)) + 1 then w else 0 end) / sum(w), 6) as top90 from k group by 1, 2)
select e.source, e.lang, e.n, e.n_words, e.n_chars, mean_log, sd_log, skew_log, kurt_log, p10, p50, p90, p99, case when p90 > p10 then round(((p90 - p50) - (p50 - p10)) / (p90 - p10), 6) end as kelley, top90 from e left join s on e.source is not distinct from s.source and e.lang is not distinct from s.lang"""


@query(_profile_sql())
def job2_text_profile(spark, d):
    """The profile of all documents; the second run finds no new files."""
    folder, config = _folder(spark, "text-profile"), text_profile.settings()
    for _ in range(2):
        out = text_profile.run(spark, d, f"{folder}/out", f"{folder}/checkpoint", config)
    out = rounded(out, 6, skew_log=3, kurt_log=3)
    return out.withColumn("skew_log", F.col("skew_log") + 0.0)
