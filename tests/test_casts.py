"""Each cast against DuckDB on awkward texts."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from tablelens.functions import casts, textops

NUMBERS = ["1", "-1", "0", "007", "1.0", "1e3", "1.6", "2.5", "-2.5", "1_000", "0x1A", ".5", "5.", "1d", "1f", " 12", "12 ", "12\n", "", " ", "abc", "1,000", "--1", "9223372036854775807", "9223372036854775808", "1e400", "1.23e-5", "+5", "1 2"]
BOOLS = ["true", "TRUE", "t", "f", "yes", "No", "y", "n", "1", "0", "TRUE ", "on", "off", "2", ""]
DATES = ["2024-01-15", "2024-1-5", "2024/01/15", "2024 01 15", "2024-01/15", "2024-02-30", "2024-01-15 ", " 2024-01-15", "2024-13-01", "20240115", "2024", "2024-02", "2024-01-15 10:30", "2024-01-15T10:30:15", "2024-01-15 10:30:15.123456789", "2024-01-15 24:00:00", "2024-01-15 10:60", "2024-01-15 10:30:15 PM", "2024-01-15 10:30:15Z", "2024-01-15 10:30:15+02:00", "2024-01-15 10:30:15+0200", "2024-01-15  1:2:3", "10:30:00", "now", "2024.01.15", "2024-01-15 10:30:15."]


def both(spark, texts, column, sql):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = dict(df.select("i", column(F.col("s")).cast("string").alias("v")).collect())
    con = duckdb.connect()
    con.execute("create table t(i int, s varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"select i, cast({sql} as varchar) from t").fetchall())
    return {texts[i]: (got[i], want[i]) for i in got if got[i] != want[i]}


def test_bigint(spark):
    assert both(spark, NUMBERS, casts.to_bigint, "try_cast(s as bigint)") == {}


def test_double(spark):
    assert both(spark, NUMBERS, lambda c: casts.to_double(c).isNotNull(), "try_cast(s as double) is not null") == {}


def test_boolean(spark):
    assert both(spark, BOOLS, casts.to_boolean, "try_cast(s as boolean)") == {}


def test_date_and_timestamp(spark):
    assert both(spark, DATES, casts.to_timestamp, "try_cast(s as timestamp)") == {}
    assert both(spark, DATES, lambda c: casts.is_iso_date(c), "coalesce(cast(try_cast(s as date) as varchar) = s, false)") == {}


@pytest.mark.parametrize("fmt", [f for f, _ in casts.DATE_FORMATS])
def test_formats(spark, fmt):
    texts = ["2024-01-15 10:30:15.123", "2024-01-15T01:02:03", "20240115", "20240115T101112", "20240115101112", "01/15/2024 01:30:15 PM", "1/5/24", "12/31/99", "2/14/68", "2/14/69", "13/01/2024", "02-30-2024", "2-3-24", "Jan 5, 2024", "january 5, 2024", "May 5, 2024", "Mon, Feb 5, 2024", "Fri, Feb 5, 2024", " 1/5/2024 ", "1/5/2024 13:00 PM", "1/5/2024 12:00 AM", "1/5/2024 25:00:00", "1/5/2024  10:11:12", "2024021", "1/5/2024x", "1/5/2024 10:11:12.1234567"]
    assert both(spark, texts, lambda c: casts.parse_format(c, fmt), f"try_strptime(s, '{fmt}')") == {}


def test_strip_is_python_strip(spark):
    points = [chr(c) for c in itertools.chain(range(0x3100), (0xFEFF, 0x200B)) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(ord(c), f"{c}a{c}") for c in points], "i int, s string")
    cut = dict(df.select("i", textops.cut(F.col("s"))).collect())
    assert [i for i, v in cut.items() if (v == "a") != (chr(i).strip() == "")] == []


def test_number_text(spark):
    values = [10000000000.0, 1e-7, 1e16, 1.5, -2.25e-5, 0.0001, 123456789.125, 1e100, 0.1, -1e15, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = dict(df.select("i", casts.number_text(F.col("v"))).collect())
    con = duckdb.connect()
    assert [got[i] for i in range(len(values))] == [con.execute("select cast(cast(? as double) as varchar)", [v]).fetchone()[0] for v in values]
