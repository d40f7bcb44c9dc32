import json

import numpy as np
import pyarrow as pa
import pytest

from cohortlake.operators.reshape import tidy
from cohortlake.sources import lookups, readers, sinks


def test_matrix_files(spark, tmp_path):
    (tmp_path / "m.dat").write_text("1 -.5\t3\n\n 4 5e1 6 ")
    cells = {(r.i, r.j): r.value for r in readers.matrix(spark, f"file://{tmp_path}/m.dat").collect()}
    assert cells == {(0, 0): 1, (0, 1): -0.5, (0, 2): 3, (1, 0): 4, (1, 1): 50, (1, 2): 6}


def test_tensor_files(spark, tmp_path):
    data = np.arange(368 * 6).reshape(368, 6)
    np.savetxt(tmp_path / "ir.dat", data)
    found = np.zeros((2, 8, 23, 6))
    for r in readers.moment_file(spark, f"file://{tmp_path}/ir.dat", "ir").collect():
        found[r.i, r.j, r.k, r.l] = r.value
    assert np.array_equal(found, data.reshape(2, 8, 23, 6))
    np.savetxt(tmp_path / "v.dat", np.arange(36.0))
    assert sorted((r.i, r.value) for r in readers.moment_file(spark, f"file://{tmp_path}/v.dat", "var_lny").collect()) == [(i, float(i)) for i in range(36)]


def test_json_records_skip_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"i": 1, "x": [1.0, 2.0], "f": 0.5}))
    (tmp_path / "b.json").write_text('{"i": 2, "x": [1.')
    rows = readers.json_records(spark, f"file://{tmp_path}", "i long, x array<double>, f double").filter("i is not null").collect()
    assert [(r.i, r.f) for r in rows] == [(1, 0.5)]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k int, s string, v double")
    path = f"file://{tmp_path}"
    sinks.save_table(df, f"{path}/t")
    sinks.append_result(df, f"{path}/t")
    assert spark.read.parquet(f"{path}/t").count() == 4
    sinks.export_text(df, f"{path}/x", ["k", "v"], "k = 1")
    assert readers.delimited(spark, f"{path}/x", "k int, v double", "\t").collect() == [(1, 2.5)]
    sinks.export_tensor(tidy(df, ["k"], ["v"]), f"{path}/y", ["k", "stat"])
    sinks.write_json_atomically({"q": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"q": 1}
    np.save(tmp_path / "n.npy", np.eye(2))
    assert readers.npy_rows(spark, str(tmp_path / "n.npy")).count() == 2
    assert readers.arrow_table(spark, pa.table({"a": [1, 2]})).count() == 2
    assert readers.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_lookup_tables(spark):
    years = {r.yr: r for r in lookups.year_table(spark).collect()}
    assert len(years) == 55 and years[2010].cpi == 100.0
    assert lookups.age_table(spark).count() == 36 and lookups.survey_prices(spark).filter("yr = 2010").first().price == pytest.approx(100)


def test_matrix_files_are_read_in_splits(spark, tmp_path):
    lines = [f"{i}  {i * i}\t.5" if i % 7 else f"\n{i} {i * i} .5\n " for i in range(4000)]
    (tmp_path / "big.dat").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(f"file://{tmp_path}/big.dat").rdd.getNumPartitions() > 8
        rows = readers.matrix(spark, f"file://{tmp_path}/big.dat").filter("j = 1").orderBy("i").collect()
        shape = readers.matrix_shape(spark, f"file://{tmp_path}/big.dat").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.i, r.value) for r in rows] == [(i, float(i * i)) for i in range(4000)]
    assert (shape.rows, shape.least, shape.most, shape.bad) == (4000, 3, 3, 0)
