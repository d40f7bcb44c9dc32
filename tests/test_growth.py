"""Growth statistics against plain Python, and the jobs over inputs that grow."""

import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.scalar import md5_uniform
from cohortlake.plans import growth as gr
from cohortlake.plans import imputation as im
from jobs import growth_report, text_profile

DATA = "/root/testdata/sf0.001"
FLOOR = 10.0


def incomes(n=160):
    rng = np.random.default_rng(3)
    out = {}
    for i in range(n):
        yob = 1930 + i % 45
        y = {t: round(float(rng.lognormal(3, 0.8)), 2) for t in range(1990, 2004) if rng.random() < 0.85}
        out[i] = (yob, y)
    return out


def by_hand(people, t, horizons, lengths, groups, least):
    """Measures of one base year: {(agebin, bin, measure): values}."""
    rows = []
    for yob, y in people.values():
        age = t - yob
        past = [y.get(t - k) for k in range(1, 6)]
        if not 25 <= age <= 58 or past[0] is None or past[0] < FLOOR or sum(p is not None and p >= FLOOR for p in past) < least:
            continue
        seen = [max(p, FLOOR) for p in past if p is not None]
        coming = {n: (max(y[t], FLOOR) if t in y else None) if n == 1 else sum(max(y[t + k], FLOOR) for k in range(n) if t + k in y) / n for n in lengths}
        rows.append({"age": age, "agebin": min((age - 25) // 5 + 1, 7), "re": sum(seen) / len(seen), "y": y, "next": coming})
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    of_age = lambda a, f: mean([v for r in rows if r["age"] == a and (v := f(r)) is not None])
    for r in rows:
        r["residual"] = math.log(r["re"]) - math.log(of_age(r["age"], lambda x: x["re"]))
    out = {}
    for r in rows:
        own = sorted(x["residual"] for x in rows if x["agebin"] == r["agebin"])
        n = len(own)

        def cut(p):
            k = round(n * p / 100, 9)
            return (own[int(k) - 1] + own[min(int(k), n - 1)]) / 2 if k == int(k) and k >= 1 else own[max(math.ceil(k), 1) - 1]

        bin_ = 1 + sum(r["residual"] > cut(100 * i / groups) for i in range(1, groups))
        y, found = r["y"], {}
        for h in horizons:
            a, b = y.get(t), y.get(t + h)
            change = lambda x: math.log(x["y"][t + h] / x["y"][t]) if t in x["y"] and t + h in x["y"] else None  # noqa: B023, E731
            if a is not None and b is not None and b >= FLOOR / 3 and a >= FLOOR:
                found[f"log{h}"] = change(r) - of_age(r["age"], change)
            if a is not None and b is not None and (a >= FLOOR or b >= FLOOR):
                u, v = b / of_age(r["age"], lambda x: x["y"].get(t + h)), a / of_age(r["age"], lambda x: x["y"].get(t))  # noqa: B023
                found[f"arc{h}"] = 2 * (u - v) / (u + v)
        for k in lengths:
            if r["next"][k]:
                found[f"next{k}"] = math.log(r["next"][k]) - math.log(of_age(r["age"], lambda x: x["next"][k])) - r["residual"]  # noqa: B023
        for name, value in found.items():
            for key in ((r["agebin"], bin_), (r["agebin"], None), (None, None)):
                out.setdefault((*key, name), []).append(value)
    return out


def test_growth_statistics_equal_plain_python(spark):
    people = incomes()
    rows = [(i, t, yob, v) for i, (yob, y) in people.items() for t, v in y.items()]
    panel = spark.createDataFrame(rows, "id long, yr long, yob long, y double").repartition(3)
    found = gr.growth_statistics(panel, range(1990, 2004), (1996, 1997), FLOOR, 3, (1, 5), (1, 3), 4, (50,)).collect()
    for t in (1996, 1997):
        want = by_hand(people, t, (1, 5), (1, 3), 4, 3)
        got = {(r.agebin, r.bin, r.measure): r for r in found if r.base == t}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k].n == len(v) and got[k]["mean"] == pytest.approx(np.mean(v), abs=1e-9)
            assert (got[k]["min"], got[k]["max"]) == pytest.approx((min(v), max(v)), abs=1e-9)
            assert got[k].p50 == pytest.approx(np.median(v), abs=1e-9)


def test_no_people(spark):
    empty = spark.createDataFrame([], "id long, yr long, yob long, y double")
    assert gr.growth_statistics(empty, range(1990, 2004), (1996,), FLOOR, 3, (1,), (1,), 4, (50,)).count() == 0
    assert gr.income_dispersion(empty, range(1990, 2004), (1996,), FLOOR).count() == 0


def as_rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_growth_report_replaces_only_its_years(spark, tmp_path):
    config, target = growth_report.settings(), str(tmp_path / "report")
    first = as_rows(growth_report.run(spark, DATA, target, config, [1997]))
    assert {r[0] for r in first} == {1997}
    whole = as_rows(growth_report.run(spark, DATA, target, config, [1998, 1999]))
    assert {r[0] for r in whole} == {1997, 1998, 1999} and [r for r in whole if r[0] == 1997] == first
    assert as_rows(growth_report.run(spark, DATA, target, config)) == whole
    assert sorted(p.name for p in (tmp_path / "report").glob("base=*")) == ["base=1997", "base=1998", "base=1999"]


@pytest.fixture
def growing(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "", 0), (10_003, "a b  c", None, "web", 6)], docs.schema)
    for k, part in enumerate((docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1").unionByName(odd), docs.filter("doc_id % 3 = 2 and source = 'src1'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    source = tmp_path / "source" / "documents.parquet"
    source.mkdir(parents=True)

    def add(k):
        for file in (tmp_path / f"part{k}").glob("part-*.parquet"):
            shutil.copy(file, source / f"{k}-{file.name}")

    return tmp_path, add


def test_text_profile_takes_only_what_is_new(spark, growing):
    root, add = growing
    config, place = text_profile.settings(), lambda n: (str(root / "source"), str(root / n / "out"), str(root / n / "checkpoint"))
    add(0)
    text_profile.run(spark, *place("a"), config)
    files = sorted(p.name for p in (root / "a" / "out" / "measures").rglob("*.parquet"))
    add(1)
    second = as_rows(text_profile.run(spark, *place("a"), config))
    after = sorted(p.name for p in (root / "a" / "out" / "measures").rglob("*.parquet"))
    assert set(files) < set(after)  # old measures are left alone
    assert as_rows(text_profile.run(spark, *place("a"), config)) == second
    assert sorted(p.name for p in (root / "a" / "out" / "measures").rglob("*.parquet")) == after
    add(2)
    third = as_rows(text_profile.run(spark, *place("a"), config))
    assert third == as_rows(text_profile.run(spark, *place("whole"), config)) and third != second


def test_text_profile_makes_good_a_lost_run(spark, growing):
    root, add = growing
    config, place = text_profile.settings(), (str(root / "source"), str(root / "b" / "out"), str(root / "b" / "checkpoint"))
    add(0)
    text_profile.run(spark, *place, config)
    add(1)
    text_profile.take_new(spark, *place, config)  # lost before the profile
    found = as_rows(text_profile.run(spark, *place, config))
    assert found == as_rows(text_profile.run(spark, str(root / "source"), str(root / "c" / "out"), str(root / "c" / "checkpoint"), config))
    # what a repeated batch writes again replaces its rows
    measures = text_profile.stored(spark, place[1] + "/measures", text_profile.MEASURES)
    assert measures.count() == measures.select("doc_id").distinct().count()


def test_imputation_from_fitted_slots(spark):
    """Features by hand, observed incomes below the cap untouched, imputed ones at least what was observed and as the fit predicts."""
    rng = np.random.default_rng(6)
    floors, caps = {t: 5.0 for t in range(1990, 2000)}, {t: 40.0 + t - 1990 for t in range(1990, 2000)}
    rows = [(i, t, 1930 + i % 30, float(rng.lognormal(3, 0.7)) if rng.random() < 0.9 else None, float(rng.lognormal(3.4, 0.8)) if rng.random() < 0.9 else None) for i in range(400) for t in range(1990, 2000)]
    people = gr.person_arrays(spark.createDataFrame(rows, "id long, yr long, yob long, wage double, selfinc double"), range(1990, 2000), ("wage", "selfinc")).cache()
    fitted = im.imputation_coefficients(people, 1990, 1996, floors, caps, 3)
    coefficients = {}
    for r in sorted(fitted.collect(), key=lambda r: r.q):
        coefficients.setdefault(r.agebin, []).append([r.b0, *[r[f"b_{n}"] for n in im.names()]])
    assert all(len(x) == 3 for x in coefficients.values())
    slots = {r.id: int(r.u * 3) for r in spark.range(400).select("id", md5_uniform("slot", F.col("id")).alias("u")).collect()}
    by = {(i, t): (yob, w or 0.0, s) for i, t, yob, w, s in rows}
    seen = 0
    for r in im.imputed_incomes(people, fitted, 1990, (1996, 1998), 1996, floors, caps).collect():
        yob, _, own = by[r.id, r.yr]
        at = lambda k, c: by[r.id, r.yr - k][c] or 0.0  # noqa: B023, E731
        log = lambda x: math.log(x) if x >= 5.0 else 0.0
        x = [1.0] + [float(at(k, 1) < 5.0) for k in (3, 2, 1, 0)] + [log(at(k, 1)) for k in (3, 2, 1, 0)] + [float(at(k, 2) >= caps[r.yr - k]) for k in (3, 2, 1)]
        x += [float(at(k, 2) < 5.0) for k in (3, 2, 1)] + [min(log(at(k, 2)), math.log(caps[r.yr - k])) for k in (3, 2, 1)]
        group = min((r.yr - yob + 1 - 25) // 5 + 1, 7)
        want = own
        if own > caps[r.yr] and group in coefficients:
            want = max(own, math.exp(sum(a * b for a, b in zip(x, coefficients[group][slots[r.id]], strict=True))) * caps[r.yr] / caps[1996])
            seen += 1
        assert r.imputed == pytest.approx(want, rel=1e-9)
    assert seen > 50
