"""User SQL in the workbench's dialect: rewrites, clauses, and changes of tables."""

import duckdb
import pytest

from tablelens.plans import dialect, dml
from tablelens.plans.sqlrun import Runner
from tablelens.plans.workspace import Workspace

SAME = [
    r"select regexp_replace('a1b2', '\d', '') as a, regexp_replace('a1b2', '(\d)', '[\1]', 'g') as b, regexp_replace('aXbx', 'x', '$', 'gi') as c",
    "select regexp_full_match('ab' || chr(10), 'ab') as a, regexp_full_match('ab', 'a|ab') as b",
    "select gcd(12, 18) as a, gcd(0, 5) as b, lcm(4, 6) as c, even(2.5) as d, even(-2.5) as e, hamming('duck', 'luck') as f",
    "select [1, 2, 3][1] as a, [[1, 2], [3]] as b, list_slice([1, 2, 3, 4], 2, 3) as c, list_prepend(1, [2]) as d",
    "select list_filter([1, 2, 3], lambda x: x > 1) as a, list_reduce([1, 2, 3], lambda x, y: x + y) as b",
    "select {'a': 1, 'b': {'c': 'it''s'}}.b.c as x",
    "select string_split('a.b.c', '.') as a, string_split('', ',') as b",
    "select strftime(timestamp '2024-03-05 07:08:09', '%d %B %Y, %I:%M %p') as a, strftime(date '2024-03-05', 'on %A') as b, strftime(date '2024-03-05', '%-d/%-m/%y') as c",
    "select date_diff('month', date '2024-01-31', date '2024-02-01') as a, date_diff('minute', timestamp '2024-01-01 00:00:59', timestamp '2024-01-01 00:01:00') as b, date_diff('quarter', date '2023-12-31', date '2024-01-01') as c",
    "select isodow(date '2024-03-03') as a, dayofweek(date '2024-03-03') as b, century(date '2000-06-01') as c, decade(date '1999-01-01') as d, isoyear(date '2024-12-30') as e, yearweek(date '2024-12-30') as f",
    "select round(skewness(x), 9) as a, round(kurtosis(x), 9) as b, round(kurtosis_pop(x), 9) as c, round(product(x), 6) as d, round(sem(x), 9) as e from (values (1.0::double), (2.0), (3.0), (-10.0)) t(x)",
    "select a from (values (1, 2), (1, 3), (2, 5)) t(a, b) where b > 2 qualify row_number() over (partition by a order by b desc) = 1 order by a",
    "with q as (select a, b from (values (1, 2), (1, 3), (2, 5)) t(a, b) qualify rank() over (order by b desc) < 3) select sum(b) as s from q",
    "select distinct on (a) a, b from (values (1, 2), (1, 3), (2, 5)) t(a, b) order by a, b desc limit 1",
    "select sha256('x') as a, unicode('é') as b, json_valid('{\"a\": 1}') as c, json_valid('{') as d",
    "select 7::varchar as a, cast(1.5 as decimal) as b, try_cast('x' as hugeint) as c, [1, 2]::bigint[] as d, cast(['1'] as int[]) as e, 12 as text",
    "select a, row_number() over () as n, count(*) over () as k from (values (5), (4), (6)) t(a)",
    "select 'qualify \\n [x]' as \"select // *\"",
]


def plain(v):
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return round(float(v), 6) if not isinstance(v, str | bool) and v is not None and not hasattr(v, "year") else v


@pytest.mark.parametrize("sql", SAME)
def test_same_text_same_rows(spark, sql):
    want = duckdb.sql(sql)
    got = Runner(spark).query(sql)
    assert [c.lower() for c in got.columns] == [c.lower() for c in want.columns]
    assert [plain(list(r)) for r in got.collect()] == [plain(list(r)) for r in want.fetchall()]


def test_calls_and_patterns():
    assert dialect.arguments("f(a, g(b, c)), d)", 0)[0] == ["f(a, g(b, c))", "d"]
    assert dialect.date_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH" and dialect.date_pattern("%Q") is None
    assert dialect.translate("select x -- [1]\n, `y[1]`") == "select x  \n, `y[1]`"


def test_files_in_sql(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    (tmp_path / "a.csv").write_text("id,day\n1,2024-01-02\n2,2024-01-03\n")
    r = Runner(spark)
    assert r.query(f"select sum(id) as s from read_parquet('{tmp_path}/p')").first()[0] == 3
    for text in (f"read_csv('{tmp_path}/a.csv')", f"'{tmp_path}/a.csv'"):
        got = r.query(f"select a.id, max(day) as day from {text} a join read_parquet('{tmp_path}/p') p on a.id = p.id where 'from ''x.csv' <> '' group by a.id")
        assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "date"] and got.count() == 2
    assert not r.run("select * from 'x.docx'")["ok"]


def test_union_by_name(spark):
    got = Runner(spark).query("select 1 as a, 2 as b union all by name select 3 as b union by name select 1 as a, 2 as b")
    assert sorted(got.collect(), key=str) == [(1, 2), (None, 3)] and got.columns == ["a", "b"]


def test_parse_changes():
    assert dml.parse("select 1") is None and dml.parse("create function f() return 1") is None
    got = dml.parse('-- c\ncreate or replace temp table "my t" as select 1;')
    assert (got.verb, got.name, got.query, got.table, got.replace) == ("create", "my t", "select 1", True, True)
    assert dml._assignments("a = 'x, y = z', b=f(1, 2) + 1") == {"a": "'x, y = z'", "b": "f(1, 2) + 1"}


def test_changes_of_tables(spark):
    w = Workspace(spark)
    ok = lambda sql: w.run_sql(sql)["ok"]
    rows = lambda: w.run_sql("select * from dm order by 1 nulls first")["rows"]
    assert ok("create table dm as select * from (values (1, 'a'), (2, null), (3, 'where')) t(Id, name)") and [t["name"] for t in w.list_tables()] == ["dm"]
    assert not ok("create table dm as select 1 as a") and ok("create table if not exists dm as select 1 as a") and len(rows()) == 3
    assert ok("update dm set name = 'x, where', id = id * 10 where name is null or (id = 9)") and rows() == [[1, "a"], [3, "where"], [20, "x, where"]]
    assert ok("insert into dm values (4, 'd'); insert into dm (name) select 'only'") and rows()[0] == [None, "only"] and len(rows()) == 5
    assert ok("delete from dm where id > 3") and rows() == [[None, "only"], [1, "a"], [3, "where"]]
    assert not ok("insert into dm values (1)") and not ok("update dm set nope = 1")
    assert ok("alter table dm rename to dm2") and not ok("drop table dm") and ok("drop table if exists dm")
    assert ok("delete from dm2") and w.run_sql("select count(*) as n from dm2")["rows"] == [[0]] and ok("drop view dm2") and w.list_tables() == []
