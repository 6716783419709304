"""As-of, interval and positional joins, running values and grouped quantiles: against DuckDB on the same text, with keys that are cut and keys that are not."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import ordered
from tablelens.plans import shims
from tablelens.plans.sqlrun import Runner

rng = random.Random(9)


def tables():
    day = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spots = rng.sample(range(40_000), 500)
    left = [(i, None if i % 41 == 0 else rng.choice(["hot"] * 8 + ["a", "b", "lone"]), None if i % 53 == 0 else day(rng.randrange(40_000)), None if i % 7 == 0 else rng.choice([float(i % 5), rng.gauss(0, 30)])) for i in range(700)]
    right = [(i, rng.choice(["hot"] * 8 + ["a", "b", "none"]), day(s), f"v{i}") for i, s in enumerate(spots)] + [(901, None, day(3), "null")]
    spans = [(i, rng.choice(["hot", "a"]), day(s), day(s + rng.choice([0, 5, 60, 4000, 39_000]))) for i, s in enumerate(rng.choices(range(40_000), k=150))]
    return {
        "l": (left, "id int, k string, seen timestamp_ntz, x double"), "r": (right, "rid int, k string, seen timestamp_ntz, v string"),
        "s": (spans, "sid int, k string, low timestamp_ntz, high timestamp_ntz"),
    }


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    made = {}
    for n, (rows, schema) in tables().items():
        made[n] = spark.createDataFrame(rows, schema).repartition(3)
        con.register(f"{n}_", pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]))
        con.execute(f"create table {n} as select * from {n}_")
    return made, con


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)


def same(both, sql, bin_rows):
    made, con = both
    runner = Runner(next(iter(made.values())).sparkSession, bin_rows=bin_rows)
    for n, df in made.items():
        df.createOrReplaceTempView(n)
    got, want = runner.query(sql), con.sql(sql)
    assert [c.lower() for c in got.columns] == [c.lower() for c in want.columns]
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())
    return got


ASOF = [
    "select l.id, r.rid, v from l asof join r on l.k = r.k and l.seen >= r.seen",
    "select l.*, r.v as w from l asof left join r on l.k = r.k and r.seen < l.seen where l.id % 2 = 0",
    "select id, rid from l asof left join r on l.k = r.k and l.seen <= r.seen",
    "select a.id, b.rid from l a asof join (select * from r where rid % 3 > 0) b on a.k = b.k and a.seen < b.seen order by 1 limit 4000",
    "with q as (select rid, seen as t, v from r where k = 'hot') select l.id, q.v from l asof left join q on l.seen >= q.t",
    "select count(*) as n, count(distinct v) as d, r.k from l asof join r on l.k = r.k and date_trunc('second', l.seen) >= r.seen group by r.k",
]


@pytest.mark.parametrize("bin_rows", [30, 10**6])
@pytest.mark.parametrize("sql", ASOF)
def test_asof(both, sql, bin_rows):
    same(both, sql, bin_rows)


def test_asof_of_one_key_compares_no_pairs(both, spark):
    """All rows share a key: no join is left but of one row per bin."""
    n = 20_000
    left, right = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t")), spark.range(0, n, 2).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 10).alias("v"))
    found = ordered.asof(left, right, [(F.col("k"), F.col("k"))], (F.col("t"), F.col("t")), ">=", 500)
    assert found.filter(F.col("_right.v") != F.col("_left.t") / 2 * 20 - F.col("_left.t") % 2 * 10).count() == 0 and found.count() == n
    cut, parted = ordered.cut(left, ["k"], "t", 500)
    sizes = [r["count"] for r in cut.groupBy("_bin").count().collect()]
    assert parted and len(sizes) >= 30 and max(sizes) < 1500
    old = shims.asof_join(left, right.withColumnRenamed("v", "w"), "k", "t", ["w"])
    assert old.columns == ["k", "t", "w"] and old.filter("w is null").count() == 0


RUNNING = [
    "select id, row_number() over (partition by k order by id) as n, sum(x) over (partition by k order by id) as s from l",
    "select id, rank() over (partition by k order by seen) as r, dense_rank() over (partition by k order by seen) as d, count(*) over (partition by k order by seen) as c from l where seen is not null",
    "select id, min(x) over (partition by k order by id) as a, max(x) over (partition by k order by id) as b, count(x) over (partition by k order by id) as c, lag(x) over (partition by k order by id) as p from l",
    "select * from (select id, k, lag(id) over (order by id) as before from l) where before % 2 = 1",
    "select id from l where x > 0 qualify row_number() over (partition by k order by id) <= 3",
]


@pytest.mark.parametrize("bin_rows", [30, 10**6])
@pytest.mark.parametrize("sql", RUNNING)
def test_running(both, sql, bin_rows):
    same(both, sql, bin_rows)


QUANTILES = [
    "select k, quantile_cont(x, 0.25) as a, median(x) as m, quantile_cont(x, 0.9) as z, count(*) as n from l group by k",
    "select id % 3 as g, median(x) as m from l where id > 50 group by id % 3 having count(*) > 5",
    "select k, id % 2 as h, quantile_cont(abs(x), 1.0) as top from l group by k, id % 2",
    "select k, median(x) as m from (select * from l where k = 'none') group by k",
]


@pytest.mark.parametrize("bin_rows", [30, 10**6])
@pytest.mark.parametrize("sql", QUANTILES)
def test_quantiles(both, sql, bin_rows):
    same(both, sql, bin_rows)


INTERVALS = [
    "select l.id, s.sid from l join s on l.k = s.k and l.seen between s.low and s.high",
    "select l.id, s.sid, l.k as a, s.k as b from l inner join s on l.seen >= s.low and l.seen < s.high where l.id % 3 = 0",
    "select count(*) as n, s.sid from s join l on s.low < l.seen and s.high >= l.seen and s.k = l.k group by s.sid",
    "select l.id, b.lo from l join (select -5.5 as lo, 0.25 as hi union all select 0, 0 union all select -1000, 1e300) b on l.x between b.lo and b.hi",
]


@pytest.mark.parametrize("sql", INTERVALS)
def test_intervals(both, sql):
    got = same(both, sql, 10**6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_positional_and_row_numbers(both, spark):
    runner = Runner(spark)
    spark.range(0, 5000, 1, 7).createOrReplaceTempView("p")
    spark.range(100, 4100, 1, 3).select(F.col("id").alias("j"), (F.col("id") * 2).alias("v")).createOrReplaceTempView("q")
    got = runner.query("select a.id, b.j, b.v from p a positional join q b").collect()
    assert Counter((r.id, r.j, r.v) for r in got) == Counter((i, *((100 + i, 200 + 2 * i) if i < 4000 else (None, None))) for i in range(5000))
    assert runner.query("select * from p positional join q").columns == ["id", "j", "v"]
    got = runner.query("select id, row_number() over () as n from p where id % 3 = 0")
    assert Counter((r.id, r.n) for r in got.collect()) == Counter((i, i // 3 + 1) for i in range(0, 5000, 3))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("_b")[0] or got.count()
    shuffled = runner.query("select n, row_number() over () as i from (select id % 97 as n, count(*) as c from p group by 1)").collect()
    assert sorted(r.i for r in shuffled) == list(range(1, 98)) and len({r.n for r in shuffled}) == 97


def test_bins_are_looked_up_without_all_bounds_beside_a_row(spark):
    """Thousands of bins: each row's number of bounds below it, with a few of them beside it at a time."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 501 > 0, F.floor(F.col("id") * 7919 % 20_011 / 3)).alias("t"))
    got, parted = ordered.cut(df, ["k"], "t", 20)
    rows = got.select("k", "t", "_bin").collect()
    assert parted and len({(r.k, r._bin) for r in rows}) > 600
    for k in (0, 1):
        mine = sorted(((r.t, r._bin) for r in rows if r.k == k and r.t is not None), key=lambda x: x[0])
        assert all(b <= c and (b == c or s < t) for (s, b), (t, c) in zip(mine, mine[1:], strict=False))
        assert {r._bin for r in rows if r.k == k and r.t is None} == {0}
    assert "filter(_bounds" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_dealt_to_bins_of_intervals_are_not_broadcast(both):
    made, _ = both
    got = ordered.interval_join(made["l"], made["s"], [(F.col("k"), F.col("k"))], F.col("seen"), F.col("low"), F.col("high"))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 100


def test_quantiles_of_few_groups_meet_their_rows_by_broadcast(both):
    """No row of the relation is dealt out by its group."""
    got = same(both, QUANTILES[0], 30)
    made, _ = both
    spark = next(iter(made.values())).sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = same(both, QUANTILES[0], 30)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "broadcast" in plan and got.count() == 5
