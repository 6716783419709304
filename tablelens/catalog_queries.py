"""Queries over the supplied tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import casts, textops
from .operators import ddl, derive, infer, profile
from .operators.profile import ROW
from .plans import shims
from .plans.sqlrun import Runner, statement
from .sources import parquet, tokens
from .streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def take(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return take


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL over the tables as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statement(spark, text, **{n: _t(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text})

    _QUERIES[name] = run
    plain = text
    for n in NAMES:
        plain = plain.replace("{" + n + "}", n)
    _SQL[name] = oracle or plain


def same_text(name: str, text: str, **options) -> None:
    """A query whose text both engines get, here by way of the rewrites of user SQL. options: of the runner."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Runner(spark, **options).query(text, **{n: _t(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text})

    _QUERIES[name] = run
    _SQL[name] = text
    for n in NAMES:
        _SQL[name] = _SQL[name].replace("{" + n + "}", n)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


_COMMON = "count(*) AS row_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, min({c}) AS min_value, max({c}) AS max_value"
_VARCHAR = _COMMON + r""", CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, count(*) FILTER ({c} = '') AS empty_count,
 count(*) FILTER (regexp_full_match({c}, '\s+')) AS whitespace_only_count, count(*) FILTER ({c} <> trim({c})) AS edge_space_count, CAST(0 AS BIGINT) AS unicode_edge_count,
 count(*) FILTER (strpos({c}, ' ') > 0) AS contains_space_count, count(*) FILTER (regexp_full_match({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS email_count,
 count(try_cast({c} AS DATE)) AS sniff_date, count(try_cast({c} AS TIMESTAMP)) AS sniff_timestamp, count(try_cast({c} AS BIGINT)) AS sniff_bigint, count(try_cast({c} AS DOUBLE)) AS sniff_double, count(try_cast({c} AS BOOLEAN)) AS sniff_boolean"""


@query("SELECT " + _VARCHAR.format(c="o_orderpriority") + " FROM orders")
def profile_varchar_orders(spark, sf_dir):
    return _longs(profile.facts(_t(spark, sf_dir, "orders"), "o_orderpriority"))


@query("SELECT " + _VARCHAR.format(c="text") + " FROM documents")
def profile_varchar_documents(spark, sf_dir):
    return _longs(profile.facts(_t(spark, sf_dir, "documents"), "text"))


@query("SELECT " + _COMMON.format(c="l_extendedprice") + ", count(*) FILTER (l_extendedprice = 0) AS zero_count, count(*) FILTER (l_extendedprice < 0) AS negative_count, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS stddev, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem")
def profile_numeric_lineitem(spark, sf_dir):
    df = profile.facts(_t(spark, sf_dir, "lineitem"), "l_extendedprice")
    return df.select(*[F.round(c, 4).alias(c) if c in ("mean", "median", "stddev", "q1", "q3") else F.col(c) for c in df.columns])


_TEMPORAL = ", min({c}) AS earliest, max({c}) AS latest, count(*) FILTER ({c} > TIMESTAMP '2024-01-15 00:00:00') AS future_count, count(DISTINCT year({c})) AS unique_years, CAST(date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)) AS BIGINT) AS range_days"
_AS_OF = dt.datetime(2024, 1, 15)


@query("SELECT " + (_COMMON + _TEMPORAL).format(c="ts") + " FROM events")
def profile_temporal_events(spark, sf_dir):
    return _longs(profile.facts(_t(spark, sf_dir, "events"), "ts", F.lit(_AS_OF).cast("timestamp_ntz")))


@query("SELECT " + (_COMMON + _TEMPORAL).format(c="o_orderdate") + " FROM orders")
def profile_temporal_orders(spark, sf_dir):
    return _longs(profile.facts(_t(spark, sf_dir, "orders"), "o_orderdate", F.lit(_AS_OF).cast("timestamp_ntz")))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def profile_top_values(spark, sf_dir):
    return profile.top_values(_t(spark, sf_dir, "orders"), "o_orderpriority")


@query("WITH n AS (SELECT min(length(p_name)) AS a, max(length(p_name)) AS b FROM part) SELECT min(p_partkey) FILTER (length(p_name) = a) AS min_length_row, min(p_partkey) FILTER (length(p_name) = b) AS max_length_row FROM part, n")
def profile_first_rows(spark, sf_dir):
    df = _t(spark, sf_dir, "part").withColumn(ROW, F.col("p_partkey"))
    row = profile.facts(df, "p_name").first()
    found = profile.first_rows(df, "p_name", {"min_length_row": row["min_length"], "max_length_row": row["max_length"]})
    return spark.createDataFrame([tuple(found.values())], "min_length_row long, max_length_row long")


_SUM = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")))


@query(_SUM)
def summarize_orders(spark, sf_dir):
    return profile.summarize(_t(spark, sf_dir, "orders"))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS _src_row_num, n_nationkey, n_name, n_regionkey FROM nation")
def parquet_row_numbers(spark, sf_dir):
    return parquet.read_numbered(spark, [f"{sf_dir}/nation.parquet"])


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS _src_row_num, r_regionkey, r_name, NULL::INT AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INT AS n_regionkey FROM region UNION ALL SELECT CAST(6 + n_nationkey AS BIGINT), NULL, NULL, n_nationkey, n_name, n_regionkey FROM nation")
def parquet_union_by_name(spark, sf_dir):
    return parquet.read_numbered(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"]).select(ROW, "r_regionkey", "r_name", "n_nationkey", "n_name", "n_regionkey")


def _as_texts(df: DataFrame) -> DataFrame:
    return df.select(*[profile.as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def derive_roundtrip_orders(spark, sf_dir):
    return derive.auto_derive(_as_texts(_t(spark, sf_dir, "orders"))).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def derive_roundtrip_events(spark, sf_dir):
    return derive.auto_derive(_as_texts(_t(spark, sf_dir, "events"))).withColumn("value", F.col("value").cast("double"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'")
def derive_apply_where(spark, sf_dir):
    df = _as_texts(_t(spark, sf_dir, "orders"))
    specs = [derive.CastSpec("o_orderkey", "id", "BIGINT"), derive.CastSpec("o_orderdate", "day", "DATE", via_timestamp=True), derive.CastSpec("o_totalprice", "price", "DOUBLE")]
    return derive.apply(df, specs, "cast(o_totalprice as double) > 250000 and o_orderstatus <> 'P'")


@query("SELECT event_id, ts::TIMESTAMP AS stamp FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def derive_us_format(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select(F.col("event_id"), F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("t"))
    return df.select("event_id", casts.parse_format(F.col("t"), "%m/%d/%Y %I:%M:%S %p").alias("stamp"))


@query("WITH s AS (SELECT CAST(l_extendedprice AS VARCHAR) AS s FROM lineitem) SELECT CAST(max(length(split_part(s, '.', 1))) AS BIGINT) AS whole, CAST(max(length(rtrim(split_part(s, '.', 2), '0'))) AS BIGINT) AS fraction, CAST(max(CAST(contains(s, '.') AS INT)) AS BIGINT) AS dot FROM s")
def decimal_sizing_lineitem(spark, sf_dir):
    df = _as_texts(_t(spark, sf_dir, "lineitem").select("l_extendedprice"))
    return _longs(df.agg(*infer._sizes(F.col("l_extendedprice"))))


@query("SELECT * FROM (SELECT min(o_orderkey) AS value FROM orders) UNION ALL SELECT value FROM (SELECT DISTINCT o_orderkey AS value FROM orders ORDER BY 1 LIMIT 24 OFFSET 1) UNION ALL SELECT value FROM (SELECT DISTINCT o_orderkey AS value FROM orders ORDER BY 1 DESC LIMIT 25)")
def bracket_sample_orders(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("v"))
    return spark.createDataFrame([(int(v),) for v in infer.bracket_sample(df, "v")], "value long")


@query("SELECT count(s) AS total, count(s) FILTER (regexp_full_match(s, '-?(0|[1-9]\\d*)(\\.\\d+)?')) AS plain, CAST(max(length(split_part(replace(s, '-', ''), '.', 1))) AS BIGINT) AS whole, CAST(max(CASE WHEN contains(s, '.') THEN length(rtrim(split_part(s, '.', 2), '0')) ELSE 0 END) AS BIGINT) AS fraction, CAST(max(CAST(contains(s, '.') AS INT)) AS BIGINT) AS dot FROM (SELECT CAST(c_acctbal AS VARCHAR) AS s FROM customer)")
def ddl_number_facts(spark, sf_dir):
    facts = ddl.number_facts(casts.number_text(F.col("c_acctbal")))
    return _longs(_t(spark, sf_dir, "customer").agg(*[facts[k].alias(k) for k in ("total", "plain", "whole", "fraction", "dot")]))


@query("SELECT count(ts) AS total, min(ts) AS first, count(*) FILTER (date_trunc('day', ts) <> ts) AS timed FROM events")
def ddl_stamp_facts(spark, sf_dir):
    facts = ddl.stamp_facts(F.col("ts"))
    return _t(spark, sf_dir, "events").agg(*[facts[k].alias(k) for k in ("total", "first", "timed")])


_FIT = "CASE WHEN min({c}) >= 0 AND max({c}) <= 255 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'integer' ELSE 'bigint' END"


@query(" UNION ALL ".join(f"SELECT '{c}' AS source, {t} AS sql_type, count(*) <> count({c}) AS nullable FROM part" for c, t in (("p_partkey", _FIT.format(c="p_partkey")), ("p_name", "'varchar'"), ("p_size", _FIT.format(c="p_size")))))
def ddl_types_part(spark, sf_dir):
    found = ddl.column_types(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "duckdb")
    return spark.createDataFrame([(c.source, c.sql_type, c.nullable) for c in found], "source string, sql_type string, nullable boolean")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS amount, CASE WHEN o_orderkey % 10 = 0 THEN 'NA' ELSE o_orderstatus END AS status FROM orders")
def placeholder_nulling(spark, sf_dir):
    na = F.col("o_orderkey") % 10 == 0
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(na, "NA").otherwise(casts.number_text(F.col("o_totalprice"))).alias("amount"), F.when(na, "NA").otherwise(F.col("o_orderstatus")).alias("status"))
    return tokens.nullify(df)


@query("SELECT c_custkey, c_name AS stripped FROM customer")
def strip_edge_blanks(spark, sf_dir):
    padded = F.concat(F.lit("  \t"), F.col("c_name"), F.lit("　\r\n"))
    return _t(spark, sf_dir, "customer").select("c_custkey", textops.strip(padded).alias("stripped"))


@query("SELECT e.event_id, e.user_id, e.ts, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def sql_asof_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return shims.asof_join(e.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["last_purchase"])


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def sql_distinct_on(spark, sf_dir):
    return shims.distinct_on(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) = 1")
def sql_qualify(spark, sf_dir):
    rank = F.rank().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity")))
    return shims.qualify(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), rank, lambda r: r == 1)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windows.windowed_counts(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def time_buckets(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(shims.time_bucket(F.col("ts"), 900).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


sql_query("sql_join_inner", "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey")
sql_query("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
sql_query("sql_join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey")
sql_query("sql_join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql_query("sql_join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql_query("sql_join_range", "SELECT r_regionkey, count(*) AS n FROM {region} JOIN {nation} ON n_nationkey > r_regionkey * 5 AND n_nationkey <= r_regionkey * 5 + 5 GROUP BY r_regionkey")
sql_query("sql_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql_query("sql_lateral", "SELECT n_name, x.m FROM {nation}, LATERAL (SELECT n_nationkey * 2 AS m) x")
sql_query("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql_query("sql_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
sql_query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql_query("sql_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY ALL HAVING count(*) > 12")
sql_query("sql_aggregate_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
sql_query("sql_arg_max", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey")
sql_query("sql_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("sql_quantiles", "SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
sql_query("sql_bool_aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 499000) AS any_big FROM {orders} GROUP BY o_orderstatus")
sql_query("sql_window_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("sql_window_lag", "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS first_key FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("sql_window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3 FROM {events}")
sql_query("sql_window_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM {orders}")
sql_query("sql_window_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_buy FROM {events}", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_buy FROM events")
sql_query("sql_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql_query("sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("sql_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql_query("sql_except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT s_suppkey FROM {supplier}")
sql_query("sql_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
sql_query("sql_cte_recursive", "WITH RECURSIVE t(k, steps) AS (SELECT CAST(s_suppkey AS BIGINT), CAST(0 AS BIGINT) FROM {supplier} UNION ALL SELECT CASE WHEN k % 2 = 0 THEN CAST(FLOOR(k / 2) AS BIGINT) ELSE k - 1 END, steps + 1 FROM t WHERE k > 1) SELECT k, steps, count(*) AS n FROM t GROUP BY k, steps")
sql_query("sql_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
sql_query("sql_strings", "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 4) AS s, replace(p_name, 'a', 'A') AS r, CAST(instr(p_name, ' ') AS BIGINT) AS i, lpad(CAST(p_size AS STRING), 5, '0') AS pad, split_part(p_type, ' ', 1) AS w, concat(p_brand, '/', p_type) AS c FROM {part}", "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 4) AS s, replace(p_name, 'a', 'A') AS r, CAST(strpos(p_name, ' ') AS BIGINT) AS i, lpad(CAST(p_size AS VARCHAR), 5, '0') AS pad, split_part(p_type, ' ', 1) AS w, concat(p_brand, '/', p_type) AS c FROM part")
sql_query("sql_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, date_format(o_orderdate, 'yyyy/MM/dd') AS f FROM {orders}", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, extract(year FROM o_orderdate) AS y, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS d, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders")
sql_query("sql_math", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS r, floor(c_acctbal) AS f, c_custkey % 7 AS m, c_custkey div 7 AS q FROM {customer}", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, c_custkey // 7 AS q FROM customer")
sql_query("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql_query("sql_arrays", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x), 3) AS norm, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS pos FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 3) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos FROM embeddings")
sql_query("sql_unnest", "SELECT vec_id, posexplode.pos + 1 AS i, round(CAST(posexplode.col AS DOUBLE), 4) AS v FROM {embeddings}, LATERAL posexplode(embedding) posexplode", "SELECT vec_id, generate_subscripts(embedding, 1) AS i, round(CAST(unnest(embedding) AS DOUBLE), 4) AS v FROM embeddings")
sql_query("sql_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '-') AS st FROM {orders}")
sql_query("sql_struct", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey) AS s FROM {nation})", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, {'a': n_name, 'b': n_regionkey} AS s FROM nation)")
sql_query("sql_values_distinct", "SELECT DISTINCT n_regionkey, b FROM {nation} JOIN VALUES (0, 'x'), (0, 'x'), (2, 'y') AS t(a, b) ON n_regionkey = a", "SELECT DISTINCT n_regionkey, b FROM nation JOIN (VALUES (0, 'x'), (0, 'x'), (2, 'y')) AS t(a, b) ON n_regionkey = a")


# user SQL in the workbench's own dialect
same_text("surface_qualify", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
same_text("surface_qualify_grouped", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderpriority QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) = 1")
same_text("surface_distinct_on", "SELECT k, day FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS k, o_orderdate AS day FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey) t")
same_text("surface_exclude", 'SELECT * EXCLUDE (c_acctbal), c_custkey // 7 AS "week of" FROM {customer} -- a comment')
same_text("surface_regexp", r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '<\0>') AS one, regexp_replace(p_name, '([a-z])([a-z])', '\2\1', 'g') AS every, regexp_extract(p_type, '\w+') AS first_word, regexp_matches(p_brand, '\d') AS digit, regexp_full_match(p_brand, '\w+#\d+') AS whole FROM {part}")
same_text("surface_strings", "SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS bytes, CAST(strpos(p_name, 'a') AS BIGINT) AS at, starts_with(p_type, 'S') AS s, array_to_string(string_split(p_name, ' '), '|') AS parts, sha256(p_name) AS h, CAST(unicode(p_name) AS BIGINT) AS u, round(jaccard(p_name, p_type), 6) AS j, CAST(levenshtein(p_name, p_type) AS BIGINT) AS lev, 'it''s' AS quoted FROM {part}")
same_text("surface_dates", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S at %j') AS text, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours, date_diff('week', TIMESTAMP '2024-01-03 00:30:00', ts) AS weeks, CAST(dayofweek(ts) AS BIGINT) AS dow, CAST(isodow(ts) AS BIGINT) AS iso, CAST(yearweek(ts) AS BIGINT) AS yw, epoch_ms(ts) AS ms, CAST(century(ts) AS BIGINT) AS c FROM {events}")
same_text("surface_buckets", "SELECT time_bucket(INTERVAL '7' DAY, ts) AS week, time_bucket(INTERVAL '25' MINUTE, ts) AS part, count(*) AS n FROM {events} GROUP BY ALL")
same_text("surface_math", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, even(p_retailprice) AS e, isfinite(p_retailprice) AS f FROM {part}")
same_text("surface_lists", "SELECT vec_id, round(list_cosine_similarity(embedding, list_transform(embedding, lambda x: x + 1)), 4) AS cos, round(list_distance(embedding, embedding), 4) AS zero, CAST(list_position(list_sort([3, 1, 2]), 2) AS BIGINT) AS at, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(list_sum(embedding[2:4]), 4) AS some, list_contains([1, 2], label) AS has FROM {embeddings}")
same_text("surface_structs", "SELECT n_nationkey, s.a AS a, s.b[2] AS b FROM (SELECT n_nationkey, {'a': n_name, 'b': [n_regionkey, n_nationkey]} AS s FROM {nation}) t")
same_text("surface_aggregates", "SELECT l_returnflag, arg_max(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS a, round(quantile_cont(l_quantity, 0.3), 4) AS q, quantile_disc(l_quantity, 0.3) AS qd, round(skewness(l_extendedprice), 5) AS sk, round(kurtosis(l_extendedprice), 5) AS ku, round(sem(l_tax), 8) AS e, countif(l_tax > 0.05) AS n FROM {lineitem} GROUP BY l_returnflag")
same_text("surface_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM {events}")
