"""Versions of changed tables, and sketches that merge across loads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import sketches
from tablelens.plans.versions import Versioned
from tablelens.plans.workspace import Workspace

rng = random.Random(8)


def ok(w, sql):
    got = w.run_sql(sql)
    assert got["ok"], got
    return got


def test_versions(spark):
    w = Workspace(spark)
    w.register("t", spark.range(0, 1000, 1, 10).select("id", F.concat(F.lit("n"), "id").alias("a b,c"), F.lit(1).alias("_file")))
    ok(w, "update t set _file = 2 where id between 100 and 120")
    held = w.versions["t"]
    assert held.costs == [(0, 10), (9, 1)]  # one file of ten had such rows
    ok(w, "delete from t where id >= 950")
    ok(w, "insert into t (id) values (5000), (5001)")
    ok(w, "delete from t where id = -1")
    assert [c[1] for c in held.costs[2:]] == [1, held.costs[3][1], 0] and held.costs[3][0] == 10
    assert w.tables["t"].count() == 952 and w.tables["t"].filter("_file = 2").count() == 21 and w.tables["t"].filter("`a b,c` is null").count() == 2
    assert w.version("t", 0).count() == 1000 and w.version("t", 1).filter("_file = 2").count() == 21 and w.version("t", 2).count() == 950
    ok(w, "alter table t rename to u")
    assert w.version("u", 0).count() == 1000 and w.tables["u"].columns == ["id", "a b,c", "_file"]
    ok(w, "delete from u")
    assert w.tables["u"].count() == 0
    ok(w, "insert into u select id, 'x', 3 from range(3)")
    ok(w, "create or replace table u as select id + 1 as id from u")
    assert sorted(r.id for r in w.tables["u"].collect()) == [1, 2, 3] and "u" not in w.versions
    path = held.path
    w.register("v", spark.range(3).toDF("id"))
    ok(w, "update v set id = id * 2")
    path = w.versions["v"].path
    w.drop("v")
    assert "v" not in w.versions and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_many_changes_stay_short_to_plan(spark):
    table = Versioned.of(spark.createDataFrame([(0, "a")], "id int, v string"))
    sizes = []
    for i in range(1, 9):
        table.insert(spark.createDataFrame([(i, "b")], "id int, v string"))
        table.change(F.col("id") == i, lambda rows, i=i: rows.withColumn("v", F.lit(f"c{i}")))
        sizes.append(len(table.at()._jdf.queryExecution().optimizedPlan().toString().split("\n")))
    assert max(sizes) == min(sizes) and sorted(r.v for r in table.at().collect()) == ["a", *[f"c{i}" for i in range(1, 9)]]
    assert len(table.versions) == 17 and table.at(2).count() == 2


def test_sketches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 10 == 0 else rng.randrange(3000), rng.choice([rng.gauss(0, 5), float("nan")]), f"u{rng.randrange(700)}", day + dt.timedelta(minutes=i), i % 2 == 0) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, k int, x double, s string, at timestamp_ntz, b boolean").repartition(6)
    for k in range(3):
        sketches.save(sketches.sketch(df.filter(F.col("id") % 3 == k)), str(tmp_path / "states"))
    got = {r.name: r for r in sketches.estimates(sketches.stored(spark, str(tmp_path / "states"))).collect()}
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert got[c].rows == 12_000 and abs(got[c].distinct_count - exact[c]) <= 0.06 * exact[c] + 1, c
    assert got["k"].filled == 10_800 and got["s"].quantiles is None and got["b"].quantiles is None
    for c, value in (("id", lambda r: r[0]), ("k", lambda r: r[1]), ("x", lambda r: r[2])):
        known = sorted(v for r in rows if (v := value(r)) is not None and v == v)
        for p, q in zip((0.25, 0.5, 0.75), got[c].quantiles, strict=True):
            assert abs(sum(v <= q for v in known) / len(known) - p) < 0.03, (c, p)
    assert abs(got["at"].quantiles[1] - (day - dt.datetime(1970, 1, 1)).total_seconds() - 6000 * 60) < 0.03 * 12_000 * 60
    assert (float(got["id"].low), float(got["id"].high)) == (0, 11_999) and got["at"].low == "2024-01-01 00:00:00"
    none = sketches.estimates(sketches.merge(sketches.sketch(df.limit(0)), sketches.sketch(df.limit(0)))).collect()
    assert all(r.rows == 0 and r.distinct_count == 0 and r.quantiles is None for r in none)


@pytest.mark.parametrize("parts", [1, 5])
def test_merged_sketches_are_like_one(spark, parts):
    df = spark.range(50_000).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(977)))
    merged = sketches.merge(*[sketches.sketch(df.filter(F.col("id") % parts == i)) for i in range(parts)])
    got = {r.name: r for r in sketches.estimates(merged, (0.1, 0.9)).collect()}
    assert abs(got["id"].distinct_count - 50_000) < 2500 and abs(got["g"].distinct_count - 977) < 50
    assert abs(got["id"].quantiles[0] - 5000) < 1000 and abs(got["id"].quantiles[1] - 45_000) < 1000
