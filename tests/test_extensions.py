"""Streaming views, the survey pipeline and the cohort simulators."""

import numpy as np
from pyspark.sql import functions as F

from cohortlake.operators import columns as co
from cohortlake.plans import cohorts, survey
from cohortlake.sources.lookups import survey_prices
from cohortlake.streaming import panels


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = panels.windowed_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.user_id, r.start, r.n, round(r.y, 6)) for r in df.collect())
    assert key(spark.table("totals")) == key(panels.windowed_totals(events)) != []


def test_sessions(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + timedelta(minutes=m)) for m in (0, 10, 39, 100)] + [(2, start)], "user_id long, ts timestamp")
    assert sorted((r.user_id, r.n) for r in panels.sessions(df).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_survey(spark):
    rng = np.random.default_rng(0)
    rows = [(p, t, 25 + p % 20 + (t - 1999), float(np.exp(10 + rng.normal() * 0.4)), p % 3 if t > 1999 else None) for p in range(60) for t in (1999, 2001, 2003)]
    rows += [(99, 1999, 30, 1e4, 1), (99, 2003, 34, 1e4, 1), (98, 1999, 30, None, 1), (98, 2001, 32, 5e4, 1)]
    panel = spark.createDataFrame(rows, "person long, year long, age int, y double, educ int")
    clean = survey.cleaned(panel, survey_prices(spark))
    assert {r.person for r in clean.select("person").distinct().collect()} == set(range(60)) and clean.filter("educ is null").count() == 0
    groups = survey.change_groups(clean.withColumn("educ", F.col("educ").cast("int")), ["educ"])
    assert groups.filter("year = 1999 and change is not null").count() == 0
    for r in groups.filter("change is not null").collect():
        assert r.grp == 1 + sum(r.change >= e for e in survey.CHANGE_EDGES)
    assert survey.robust_statistics(groups, ["year"]).count() == 2
    wide = spark.createDataFrame([(1, 10, 1, 11, 2), (2, 20, 2, 21, 1)], "person long, intid1999 int, seq1999 int, intid2001 int, seq2001 int")
    assert sorted(survey.heads(wide, [1999, 2001]).collect()) == [(1, 1999, 10), (2, 2001, 21)]
    paid = spark.createDataFrame([(5.0, 3), (5.0, 9), (None, 3)], "a double, f int")
    assert [r.t for r in survey.annual_amounts(paid, [("a", "f", "t")]).collect()] == [260.0, 0.0, 0.0]


def test_cohorts(spark):
    people = spark.range(4000).select("id", F.lit(1950).alias("cohort"))
    start = cohorts.first_year(people)
    z = start.agg(F.avg("alpha"), F.stddev("alpha"), F.corr("alpha", "beta")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 0.2998) < 0.02 and abs(z[2] - 0.768) < 0.05
    later = cohorts.projected(start)
    assert later.select("age").distinct().collect() == [(26,)] and later.filter("income < 0 or income is null").count() == 0
    assert later.repartition(7).agg(F.sum("income")).first()[0] - cohorts.projected(cohorts.first_year(people.repartition(3))).agg(F.sum("income")).first()[0] < 1e-6
    base = cohorts.base_year(spark, 3, range(1950, 1956), 1985)
    assert sorted((r.cohort, r.age) for r in base.select("cohort", "age").distinct().collect()) == [(c, 1985 - c) for c in range(1950, 1956)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, None)], "a1 int, a2 int, b int, a10 int")
    assert co.matching(df, "a?") == ["a1", "a2"] and co.keep(df, "a*").columns == ["a1", "a2", "a10"] and co.drop(df, "a*").columns == ["b"]
    assert co.zero_filled(df, "a*").first().a10 == 0 and co.ordered(df, "b").columns[0] == "b"
    assert co.labelled(df, {"b": "x"}).schema["b"].metadata == {"label": "x"}
