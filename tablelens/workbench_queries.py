"""Queries that go through files, workspaces and exports, each with the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import _as_texts, _t, query, same_text, sql_query
from .functions import casts, textops
from .operators import ddl, derive, dialects, export, infer, naming, profile, sketches
from .operators.profile import ROW
from .plans.dialect import date_pattern
from .plans.workspace import Workspace
from .scratch import work_dir
from .sources import delimited, excel, jdbc, parquet, records, sniff


def _folder() -> Path:
    """A folder for the files of one query: the workbench reads and writes files of the machine it runs on."""
    path = Path(tempfile.mkdtemp(prefix="tablelens-"))
    atexit.register(shutil.rmtree, path, True)
    return path


def _space(spark: SparkSession, sf_dir: str, *names: str) -> Workspace:
    w = Workspace(spark)
    for n in names:
        w.register(n, _t(spark, sf_dir, n))
    return w


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# text files


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def text_roundtrip_orders(spark, sf_dir):
    path = str(_folder() / "orders.csv")
    export.to_flat(_t(spark, sf_dir, "orders"), path, delimiter=",")
    got = Workspace(spark).load_file(path)
    return derive.auto_derive(got.df.drop(ROW)).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents")
def text_quoted_breaks_documents(spark, sf_dir):
    path = str(_folder() / "documents.txt")
    export.to_flat(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, delimiter="|", trim=False)
    return delimited.load(spark, path, {"nullify_tokens": []}).df.drop(ROW)


def _broken_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders as text in which every 100th has fields too many, every 77th a field less, and one quote stays open."""
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.concat_ws(",", k, "o_custkey", "o_orderstatus")
    line = F.when(k % 100 == 0, F.concat(line, F.lit(",x,y"))).when(k % 77 == 0, F.concat_ws(",", k, "o_custkey")).otherwise(line)
    path = work_dir(spark)
    ends = spark.createDataFrame([(0, "key,customer,status"), (2, '-1,"open,F')], "part int, line string")
    rows = ends.withColumn("key", F.lit(0).cast(o.schema["o_orderkey"].dataType)).unionByName(o.select(F.lit(1).alias("part"), line.alias("line"), F.col("o_orderkey").alias("key")))
    # a range of the order to a file, named in its order
    rows.orderBy("part", "key").select("line").write.text(path)
    return path


_BAD = "o_orderkey % 100 = 0"


@query(f"SELECT 'TOO MANY COLUMNS' AS error_type, CAST(o_orderkey AS VARCHAR) || ',' || o_custkey || ',' || o_orderstatus || ',x,y' AS csv_line, 1 + (SELECT count(*) FROM orders i WHERE i.o_orderkey <= o.o_orderkey) AS line FROM orders o WHERE {_BAD} UNION ALL SELECT 'UNQUOTED VALUE', '-1,\"open,F', 2 + (SELECT count(*) FROM orders)")
def text_rejects(spark, sf_dir):
    return delimited.load(spark, _broken_orders(spark, sf_dir)).rejects.select("error_type", "csv_line", "line")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) AS _src_row_num, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderkey % 77 <> 0 THEN o_orderstatus END AS status FROM orders WHERE NOT {_BAD}")
def text_padding_and_numbers(spark, sf_dir):
    return delimited.load(spark, _broken_orders(spark, sf_dir)).df


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS _src_row_num, CAST(n_nationkey AS VARCHAR) AS nr, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def text_titles_and_footer(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    path = _folder() / "report.csv"
    path.write_text("Nations\nas of today\nnr,name,region\n" + "".join(f"{r.n_nationkey},{r.n_name},{r.n_regionkey}\n" for r in rows) + f"Total,{len(rows)},\n")
    return Workspace(spark).load_file(str(path)).df


@query("SELECT c.encoding, n_name || c.tail AS name FROM nation, (VALUES ('utf-8', ' é’'), ('cp1252', ' é’'), ('latin-1', ' éü'), ('utf-16', ' é’')) c(encoding, tail)")
def text_encodings(spark, sf_dir):
    rows, out = _t(spark, sf_dir, "nation").collect(), []
    for name, tail in (("utf-8", " é’"), ("cp1252", " é’"), ("latin-1", " éü"), ("utf-16", " é’")):
        path = _folder() / "e.csv"
        path.write_bytes(("nr,name\n" + "".join(f"{r.n_nationkey},{r.n_name}{tail}\n" for r in rows)).encode(name))
        got = delimited.load(spark, str(path))
        out.append(got.df.select(F.lit(got.facts["encoding"]).alias("encoding"), "name"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def _in_encoding(text, name: str):
    """Lines whose bytes are of an encoding, for the writer of text files."""
    c = text if name != "cp1252" else F.translate(text, records.CP1252, records.CONTROLS)
    return F.encode(c, "UTF-8" if name == "utf-8" else "ISO-8859-1").cast("string")


_MARKED = {"utf-8": "Grüße, ’žluť‘ 漢", "cp1252": "Grüße, ’quoted‘", "latin-1": "Grüße"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS encoding, CAST(doc_id AS VARCHAR) AS id, lang, CASE WHEN doc_id % 3 = 0 THEN '{t} ' || doc_id ELSE 'plain ' || length(coalesce(text, '')) END AS note FROM documents" for n, t in _MARKED.items()))
def text_encodings_documents(spark, sf_dir):
    """Every document as a line of folders in three encodings, written and read in splits; a census tells which is which."""
    d, out = _t(spark, sf_dir, "documents"), None
    for name, mark in _MARKED.items():
        path = f"file://{_folder()}/notes"
        note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"{mark} "), "doc_id")).otherwise(F.concat(F.lit("plain "), F.length(F.coalesce("text", F.lit("")))))
        d.select(_in_encoding(F.concat_ws("|", "doc_id", F.coalesce("lang", F.lit("")), note), name)).write.text(path)
        got = delimited.load(spark, path, {"first_row": 0, "delimiter": "|", "nullify_tokens": []})
        one = got.df.select(F.lit(got.facts["encoding"]).alias("encoding"), F.col("col_0").alias("id"), F.col("col_1").alias("lang"), F.col("col_2").alias("note"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey % 5, o_orderkey) AS BIGINT) AS _src_row_num, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def text_folder_of_parts(spark, sf_dir):
    """Orders in five files with a header each, read by a pattern as one table whose rows are numbered through."""
    folder = _folder()
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    for k in range(5):
        export.to_flat(o.filter(F.col("key") % 5 == k).orderBy("key"), str(folder / f"part{k}.csv"), delimiter=",")
    return delimited.load(spark, f"file://{folder}/part*.csv").df


@query("SELECT d.delimiter, 4 AS fields, 1.0::DOUBLE AS coverage, CAST(max(length(c_name)) AS INT) AS longest FROM customer, (VALUES (','), ('|'), (';'), (chr(9))) d(delimiter) GROUP BY d.delimiter")
def sniff_delimiters(spark, sf_dir):
    rows, out = _t(spark, sf_dir, "customer").collect(), []
    for d in sniff.DELIMITERS:
        path = _folder() / "d.txt"
        path.write_text("key,name,nation,balance\n".replace(",", d) + "".join(d.join(map(str, (r.c_custkey, r.c_name, r.c_nationkey, r.c_acctbal))) + "\n" for r in rows))
        best = sniff.score_delimiters(path, "utf-8")[0]
        longest = delimited.load(spark, str(path)).df.agg(F.max(F.length("name"))).first()[0]
        out.append((best.delimiter, best.fields, best.coverage, longest))
    return _rows(spark, out, "delimiter string, fields int, coverage double, longest int")


@query("SELECT * FROM (VALUES ('header', 1, 0), ('titles', 3, 0), ('none', 0, 0), ('footer', 1, 1)) t(shape, first_row, footer)")
def sniff_layouts(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()
    body = "".join(f"{r.s_suppkey},{r.s_name},{r.s_acctbal}\n" for r in rows)
    texts = {"header": "key,name,balance\n" + body, "titles": "Suppliers\nall\nkey,name,balance\n" + body, "none": body, "footer": "key,name,balance\n" + body + f"Total,{len(rows)}\n"}
    out = []
    for shape, text in texts.items():
        path = _folder() / "l.csv"
        path.write_text(text)
        got = sniff.detect_layout(path, "utf-8", ",")
        out.append((shape, got.first_row, got.footer))
    return _rows(spark, out, "shape string, first_row int, footer int")


@query("SELECT CAST(i AS INT) AS i, CASE WHEN i = 0 THEN 'n_nationkey|n_name|n_regionkey' ELSE n_nationkey || '|' || n_name || '|' || n_regionkey END AS line FROM range(11) r(i) LEFT JOIN nation ON n_nationkey = i - 1")
def line_preview(spark, sf_dir):
    path = str(_folder() / "n.csv")
    export.to_flat(_t(spark, sf_dir, "nation").orderBy("n_nationkey"), path)
    return _rows(spark, list(enumerate(delimited.preview_lines(path, 11)["lines"])), "i int, line string")


@query("SELECT split_part(f, '/', -1) AS name FROM (VALUES ('x/a.parquet'), ('x/b.PARQUET')) t(f)")
def parquet_siblings(spark, sf_dir):
    folder = _folder()
    for name in ("b.PARQUET", "a.parquet", "c.txt"):
        export.to_parquet(_t(spark, sf_dir, "region"), str(folder / name))
    return _rows(spark, [(Path(p).name,) for p in parquet.siblings(str(folder / "a.parquet"))["paths"]], "name string")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS _src_row_num, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN '\"' || c_name ELSE c_name END AS name FROM customer")
def text_quotes_as_data(spark, sf_dir):
    """A quote that opens and never closes, in every fifth row: kept as data, as else most of the file would be one value."""
    path = f"file://{_folder()}/quotes"
    c = _t(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1)
    c.select(F.concat_ws("|", "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name")))).write.text(path)
    got = delimited.load(spark, path, {"first_row": 0, "delimiter": "|"})
    assert got.facts["quotes_as_data"]
    return got.df.toDF(ROW, "id", "name")


@query("SELECT 'utf-8' AS encoding, CAST(count(*) - 1 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS rejected FROM nation")
def sniff_bad_bytes(spark, sf_dir):
    """One wrong byte among many good characters leaves a file UTF-8, and its record a reject."""
    path = f"file://{_folder()}/bytes"
    good = F.concat_ws(",", "n_nationkey", F.concat("n_name", F.lit(" éü")))
    line = F.when(F.col("n_nationkey") == 7, F.encode(good, "ISO-8859-1").cast("string")).otherwise(good)
    _t(spark, sf_dir, "nation").select(line).write.text(path)
    got = delimited.load(spark, path, {"first_row": 0, "delimiter": ","})
    return _rows(spark, [(got.facts["encoding"], got.df.count(), got.rejects.count())], "encoding string, kept bigint, rejected bigint")


# exports


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def export_flat_customer(spark, sf_dir):
    path = str(_folder() / "c.txt")
    df = _t(spark, sf_dir, "customer").withColumn("c_name", F.concat(F.lit("  "), "c_name", F.lit("\t")))
    wanted = [export.Mapping("c_custkey", "id"), export.Mapping("c_name", "name"), export.Mapping("c_acctbal", "balance")]
    export.export(df, path, "flat", delimiter="\t", mappings=wanted)
    return spark.read.csv(path, sep="\t", header=True, schema="id bigint, name string, balance double").withColumn("balance", F.round("balance", 2))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def export_parquet_part(spark, sf_dir):
    path = str(_folder() / "p.parquet")
    Workspace(spark).export_query("select * from (select 1) limit 0", str(_folder() / "none.parquet"), "parquet")
    export.export(_t(spark, sf_dir, "part"), path, "parquet", compression="zstd")
    return spark.read.parquet(path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def export_excel_supplier(spark, sf_dir):
    path = str(_folder() / "s.xlsx")
    export.export(_t(spark, sf_dir, "supplier"), path, "excel", sheet="Suppliers")
    got = Workspace(spark).load_file(path)
    return got.df.select(F.col("s_suppkey").cast("bigint"), "s_name", F.col("s_nationkey").cast("int"), F.col("s_acctbal").cast("double"))


@query("SELECT 'Nations' AS sheet, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS header_row, 'A' AS start_col, 'C' AS end_col FROM nation")
def excel_workbook_probe(spark, sf_dir):
    path = str(_folder() / "w.xlsx")
    export.export(_t(spark, sf_dir, "nation"), path, "excel", sheet="Nations")
    w = Workspace(spark)
    (name,) = w.load_workbook(path, [{"sheet": "Nations"}])
    (sheet,) = excel.inspect(path)
    return w.tables[name].agg(F.lit(sheet["sheet"]).alias("sheet"), F.count(F.lit(1)).alias("n"), F.lit(sheet["header_row"]).cast("long").alias("header_row"), F.lit(sheet["start_col"]).alias("start_col"), F.lit(sheet["end_col"]).alias("end_col"))


@query("SELECT string_agg(line, chr(10) ORDER BY k) AS text FROM (SELECT -1 AS k, 'r_regionkey' || chr(9) || 'r_name' AS line UNION ALL SELECT r_regionkey, r_regionkey || chr(9) || r_name || ' x' FROM region)")
def clipboard_region(spark, sf_dir):
    df = _t(spark, sf_dir, "region").orderBy("r_regionkey").withColumn("r_name", F.concat("r_name", F.lit("\r\n\tx")))
    return _rows(spark, [(export.clipboard(df),)], "text string")


@query("SELECT o_orderkey AS row, 'o_totalprice' AS marked FROM orders WHERE o_totalprice >= 100000 ORDER BY 1 LIMIT 3")
def export_offending_rows(spark, sf_dir):
    df = _as_texts(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).withColumn(ROW, F.col("o_orderkey").cast("bigint"))
    wanted = [export.Mapping("o_orderkey", "key", "bigint", False), export.Mapping("o_totalprice", "price", "decimal(7, 2)", False)]
    found = export.offending_rows(df, wanted, 3)
    return _rows(spark, [(r["row"], ",".join(r["marked"])) for r in found], "row bigint, marked string")


@query("SELECT * FROM (VALUES ('C CustKey', 'c_cust_key'), ('cName', 'c_name'), ('c.name', 'c_name_1'), ('ACCTBAL', 'acctbal')) t(source, target)")
def export_mappings(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("C CustKey"), F.col("c_name").alias("cName"), F.col("c_mktsegment").alias("c.name"), F.col("c_acctbal").alias("ACCTBAL"))
    return _rows(spark, [(m.source, m.target) for m in export.suggest_mappings(df)], "source string, target string")


# DDL

_TEXT = "CASE WHEN max(length({c})) = min(length({c})) AND max(length({c})) <= 8 THEN 'char(' ELSE 'varchar(' END || max(length({c})) || ')'"
_INT = "CASE WHEN min({c}) >= 0 AND max({c}) <= 255 THEN 'tinyint' WHEN max({c}) <= 32767 THEN 'smallint' WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
_ORDER_TYPES = {"o_orderkey": _INT.format(c="o_orderkey"), "o_custkey": _INT.format(c="o_custkey"), "o_orderstatus": _TEXT.format(c="o_orderstatus"), "o_orderdate": "'date'", "o_orderpriority": _TEXT.format(c="o_orderpriority")}


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS source, {t} AS sql_type FROM orders" for c, t in _ORDER_TYPES.items()))
def ddl_sqlserver_orders(spark, sf_dir):
    found = ddl.column_types(_as_texts(_t(spark, sf_dir, "orders")), "sqlserver", trim_strings=True)
    return _rows(spark, [(c.source, c.sql_type) for c in found if c.source in _ORDER_TYPES], "source string, sql_type string")


@query(
    "WITH t AS (SELECT " + _TEXT.format(c="r_name") + " AS name FROM region) SELECT 'create table dbo.[my table]' || chr(10) || '(   [Order Key]  ' || rpad('tinyint', CAST(greatest(7, length(name)) AS INT), ' ') || '  not null' || chr(10)"
    " || '  , [select]     ' || rpad(name, CAST(greatest(7, length(name)) AS INT), ' ') || '  not null' || chr(10) || ')' || chr(10) || ';' AS ddl FROM t"
)
def ddl_text_region(spark, sf_dir):
    df = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("Order Key"), F.col("r_name").alias("select"))
    return _rows(spark, [(ddl.render("my table", ddl.column_types(df, "sqlserver"), "sqlserver", "dbo"),)], "ddl string")


@query("SELECT 'blob' AS kind, 'varbinary(' || max(length(n_name)) || ')' AS sql_type FROM nation UNION ALL SELECT 'loose', 'varchar(3)' UNION ALL SELECT 'strict', 'bit' UNION ALL SELECT 'mixed', 'varchar(6)'")
def ddl_special_types(spark, sf_dir):
    even = F.col("n_nationkey") % 2 == 0
    df = _t(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("blob"), F.when(even, "Yes").otherwise("No").alias("loose"), F.when(even, "true").otherwise("false").alias("strict"), F.when(even, "12.50").otherwise("f70390").alias("mixed"))
    return _rows(spark, [(c.source, c.sql_type) for c in ddl.column_types(df, "sqlserver")], "kind string, sql_type string")


#: Names of each form, as SQL of a row's number k and word w, in both engines, and what they become.
_NAMES = (
    ("'claim.id' || k", "'claim_id' || k"), ("'PatientID' || k", "'patient_id' || k"), ("'HTTPServer' || k", "'http_server' || k"), ("'a-b c' || k", "'a_b_c' || k"), ("'...' || repeat('.', k % 7)", "'col'"),
    ("upper(w)", "replace(lower(w), ' ', '_')"), ("upper(substr(w, 1, 1)) || lower(substr(w, 2)) || 'Id'", "replace(lower(w), ' ', '_') || '_id'"), ("'claim.' || w", "'claim_' || replace(lower(w), ' ', '_')"),
)
_NAMED = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS w FROM {nation} UNION ALL SELECT r_regionkey, r_name FROM {region} UNION ALL SELECT s_suppkey, replace(s_name, '#', '_') FROM {supplier}"


@query("SELECT * FROM (VALUES ('claim.id', 'claim_id'), ('PatientID', 'patient_id'), ('HTTPServer', 'http_server'), ('a-b c', 'a_b_c'), ('...', 'col')) t(name, snake) UNION ALL " + " UNION ALL ".join(f"SELECT {n}, {s} FROM ({_NAMED.replace('{', '').replace('}', '')})" for n, s in _NAMES))
def names_snake_case(spark, sf_dir):
    """Names of all forms: five fixed ones, and of each form one made of every nation's, region's and supplier's number and name; turned on the executors."""
    named = spark.sql(_NAMED, **{n: _t(spark, sf_dir, n) for n in ("nation", "region", "supplier")})
    fixed = _rows(spark, [(n,) for n in ("claim.id", "PatientID", "HTTPServer", "a-b c", "...")], "name string")
    names = named.select(F.explode(F.array(*[F.expr(n) for n, _ in _NAMES])).alias("name")).union(fixed)
    return names.select("name", F.pandas_udf(lambda v: v.map(naming.snake_case, na_action="ignore"), "string")("name").alias("snake"))


@query("SELECT DISTINCT p_type AS name, lower(replace(p_type, ' ', '_')) AS snake FROM part UNION SELECT DISTINCT c_mktsegment, lower(c_mktsegment) FROM customer")
def names_of_values(spark, sf_dir):
    """Types of parts and segments of customers as column names."""
    values = _t(spark, sf_dir, "part").select("p_type").union(_t(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    return _rows(spark, [(r[0], naming.snake_case(r[0])) for r in values.collect()], "name string, snake string")


@query("SELECT c.name AS source, c.quoted, CASE WHEN max(n_nationkey) <= 255 THEN 'tinyint' ELSE 'int' END AS sql_type FROM nation, (VALUES ('date', '[date]'), ('value', '[value]'), ('order', '[order]'), ('amount', 'amount'), ('a]b', '[a]]b]')) c(name, quoted) GROUP BY ALL")
def ddl_reserved_names(spark, sf_dir):
    names = ("date", "value", "order", "amount", "a]b")
    df = _t(spark, sf_dir, "nation").select(*[F.col("n_nationkey").alias(n) for n in names])
    kind = dialects.dialect("sqlserver")
    return _rows(spark, [(c.source, kind.quote(c.source), c.sql_type) for c in ddl.column_types(df, "sqlserver")], "source string, quoted string, sql_type string")


# types


def _exact(fmt: str, kind: str) -> str:
    if kind == "DATE":
        return "day"
    return "microsecond" if "%f" in fmt else "second" if "%S" in fmt else "minute"


@query(" UNION ALL ".join(f"SELECT '{f}' AS fmt, event_id, CAST(date_trunc('{_exact(f, k)}', ts) AS TIMESTAMP) AS stamp FROM events" for f, k in casts.DATE_FORMATS))
def cast_date_formats(spark, sf_dir):
    events, out = _t(spark, sf_dir, "events"), None
    for f, _ in casts.DATE_FORMATS:
        one = events.select(F.lit(f).alias("fmt"), "event_id", casts.parse_format(F.date_format("ts", date_pattern(f)), f).alias("stamp"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT o_orderkey, o_orderkey AS plain, o_totalprice AS price, o_orderstatus = 'F' AS done, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_strict_and_stripped(spark, sf_dir):
    pad = lambda c: F.concat(F.lit("  "), c, F.lit("　\t"))
    df = _as_texts(_t(spark, sf_dir, "orders"))
    df = df.select(pad(F.col("o_orderkey")).alias("o_orderkey"), "o_orderkey", pad(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("n").alias("done"), pad(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd")).alias("day")).toDF("padded", "plain", "price", "done", "day")
    specs = [derive.CastSpec("padded", "o_orderkey", "BIGINT", True), derive.CastSpec("plain", "plain", "BIGINT", True, strip_blanks=False), derive.CastSpec("price", "price", "DOUBLE", True, strip_blanks=True), derive.CastSpec("done", "done", "BOOLEAN", True), derive.CastSpec("day", "day", "DATE", True)]
    return derive.apply(df, specs)


def _texts_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _t(spark, sf_dir, "events"), F.col("event_id")
    stamp = lambda p: F.date_format("ts", p)
    return e.select(
        F.concat(n.cast("string"), F.lit("e3")).alias("double"), F.when(n % 2 == 0, "true").otherwise("false").alias("boolean"), stamp("yyyy-MM-dd").alias("date"), stamp("MM/dd/yyyy").alias("us_date"), stamp("MMM dd, yyyy").alias("named"),
        F.concat(F.lit(" "), n.cast("string")).alias("padded"), F.when(n % 50 == 0, "N/A").otherwise(n.cast("string")).alias("mostly"), F.when(n % 4 == 0, "N/A").otherwise(n.cast("string")).alias("partly"), F.when(n % 2 == 0, "x").otherwise("yy").alias("text"),
        stamp("yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.concat(n.cast("string"), F.lit(".0")).alias("whole"),
    )


@query(
    "SELECT * FROM (VALUES ('double', 'DOUBLE', NULL), ('boolean', 'BOOLEAN', NULL), ('date', 'DATE', NULL), ('us_date', 'DATE', '%m/%d/%Y'), ('named', 'DATE', '%b %d, %Y'), ('padded', 'BIGINT', NULL), ('mostly', 'BIGINT', NULL), ('partly', NULL, NULL), ('text', NULL, NULL), ('stamp', 'TIMESTAMP', NULL), ('whole', 'BIGINT', NULL)) t(source, suggested, date_format)"
)
def infer_types(spark, sf_dir):
    found = derive.suggest_casts(_texts_of_types(spark, sf_dir), with_samples=True)
    assert all(len(s.samples) == 3 for s in found)
    return _rows(spark, [(s.column, s.suggested, s.date_format) for s in found], "source string, suggested string, date_format string")


@query("SELECT c.name AS source, CASE WHEN c.k = 1 THEN 100.0 ELSE least(99.99, round(100.0 * count(*) FILTER (event_id % c.k <> 0) / count(*), 2)) END::DOUBLE AS share FROM events, (VALUES ('mostly', 50), ('partly', 4), ('padded', 1), ('whole', 1)) c(name, k) GROUP BY c.name, c.k")
def infer_coverage(spark, sf_dir):
    found = infer.analyze(_texts_of_types(spark, sf_dir).select("mostly", "partly", "padded", "whole"))
    return _rows(spark, [(c, a.coverage["BIGINT"]) for c, a in found.items()], "source string, share double")


# profiles


@query("WITH t AS (SELECT c_custkey % 3 AS k, CASE c_custkey % 3 WHEN 0 THEN chr(12288) || c_name WHEN 1 THEN c_name || ' ' ELSE c_name END AS v FROM customer) SELECT count(*) FILTER (k = 0) AS unicode_edge_count, count(*) FILTER (v <> trim(v)) AS edge_space_count FROM t")
def profile_unicode_edges(spark, sf_dir):
    third = F.col("c_custkey") % 3
    padded = F.when(third == 0, F.concat(F.lit("　"), "c_name")).when(third == 1, F.concat("c_name", F.lit(" "))).otherwise(F.col("c_name"))
    return profile.facts(_t(spark, sf_dir, "customer").select(padded.alias("v")), "v").select("unicode_edge_count", "edge_space_count")


@query("WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) SELECT doc_id, n_chars FROM documents, q WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)")
def profile_outliers_documents(spark, sf_dir):
    df = _t(spark, sf_dir, "documents")
    row = profile.facts(df, "n_chars").first()
    return profile.outliers(df, "n_chars", row["q1"], row["q3"]).select("doc_id", "n_chars")


@query(
    "WITH p AS (SELECT CASE WHEN event_id % 8 = 0 THEN NULL ELSE user_id % 7 END AS v FROM events), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM p) SELECT count(*) AS row_count, count(*) - count(v) AS null_count, round(100.0 * count(v) / count(*), 2)::DOUBLE AS fill_pct, round(100.0 * count(DISTINCT v) / count(*), 2)::DOUBLE AS cardinality_pct, round(any_value(b - a), 4)::DOUBLE AS iqr, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outlier_count FROM p, q"
)
def profile_shares(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 8 != 0, F.col("user_id") % 7).alias("v"))
    got = profile.profile(df, "v")
    keys = ("row_count", "null_count", "fill_pct", "cardinality_pct", "iqr", "outlier_count")
    return _rows(spark, [tuple(got[k] for k in keys)], "row_count bigint, null_count bigint, fill_pct double, cardinality_pct double, iqr double, outlier_count bigint")


# workspace


@query("SELECT CAST(100 + i AS BIGINT) AS place, p_partkey FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100))")
def workspace_page(spark, sf_dir):
    w = Workspace(spark)
    w.register("p", _t(spark, sf_dir, "part").select("p_partkey"))
    w.register("n", w.tables["p"].orderBy("p_partkey").select((F.col("p_partkey") - F.lit(w.tables["p"].agg(F.min("p_partkey")).first()[0]) + 1).alias(ROW), "p_partkey"))
    return _rows(spark, [tuple(r) for r in w.rows("n", 100, 50)], "place bigint, p_partkey bigint")


@query("SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, CAST(c_acctbal AS VARCHAR) DESC) AS BIGINT) AS place, c_acctbal FROM customer QUALIFY place <= 400")
def workspace_sorted(spark, sf_dir):
    w = Workspace(spark)
    w.register("c", _as_texts(_t(spark, sf_dir, "customer").select("c_acctbal")))
    return _rows(spark, [(i, float(r[0])) for i, r in enumerate(w.rows("c", 0, 400, "c_acctbal", True), 1)], "place bigint, c_acctbal double")


@query("SELECT unnest([1, 2, 3]) AS place, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation WHERE n_nationkey = 7")
def workspace_pivot_row(spark, sf_dir):
    w = Workspace(spark)
    w.register("n", _t(spark, sf_dir, "nation").withColumn(ROW, F.col("n_nationkey").cast("bigint") + 1))
    return _rows(spark, [(i, c, str(v)) for i, c, v in w.pivot_row("n", 8) if c != ROW], "place int, name string, value string")


@query("SELECT 'kept' AS name, count(*) AS n, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region")
def workspace_tables(spark, sf_dir):
    w = _space(spark, sf_dir, "nation", "region", "supplier")
    assert w.rename("nation", "kept") and w.drop("supplier") and not w.drop("supplier") and w.materialize("region")
    return _rows(spark, [(t["name"], t["rows"], t["columns"]) for t in w.list_tables()], "name string, n bigint, columns int")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(name, type)")
def workspace_schema(spark, sf_dir):
    return _rows(spark, [(c["name"], c["type"]) for c in _space(spark, sf_dir, "region").schema("region")], "name string, type string")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def workspace_save_query(spark, sf_dir):
    w = _space(spark, sf_dir, "customer")
    w.save_query("select c_nationkey, count(*) as n from customer group by all", "by_nation")
    return w.tables["by_nation"]


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'Atlantis', NULL")
def workspace_changes(spark, sf_dir):
    w = _space(spark, sf_dir, "nation")
    for sql in ("create table t as select * from nation", "update t set n_name = upper(n_name) || '!' where n_regionkey = 1", "delete from t where n_regionkey = 2", "insert into t (n_nationkey, n_name) values (100, 'Atlantis')", "alter table t rename to u"):
        got = w.run_sql(sql)
        assert got["ok"], got
    return w.tables["u"]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def workspace_first_window(spark, sf_dir):
    w = _space(spark, sf_dir, "orders")
    got = w.run_sql("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
    assert got["ok"], got
    return _rows(spark, [tuple(r) for r in got["rows"]], "o_orderkey bigint, o_totalprice double")


@query("SELECT c_custkey AS a, NULL::VARCHAR AS b FROM customer")
def sql_untyped_null(spark, sf_dir):
    return _space(spark, sf_dir, "customer").runner.query("select c_custkey as a, null as b from customer")


@query("SELECT n_name AS name, n_regionkey <> 1 AS gives FROM nation")
def sql_gives_rows(spark, sf_dir):
    """Statements made of the nations' names: of region 1 they give no rows."""
    from .plans.sqlrun import gives_rows

    forms = ("-- {0}\n(select '{0}')", "create table t as select '{0}'", "with a as (select '{0}') from a", "/* create */ describe t", "values ('{0}')")
    rows = _t(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()
    return _rows(spark, [(r.n_name, gives_rows(forms[r.n_regionkey].format(r.n_name))) for r in rows], "name string, gives boolean")


@query("SELECT CAST(max(n_nationkey) AS INT) AS top, count(*) AS n FROM nation UNION ALL SELECT CAST(max(r_regionkey) AS INT), count(*) FROM region")
def sql_files(spark, sf_dir):
    folder = _folder()
    export.to_flat(_t(spark, sf_dir, "nation"), str(folder / "n.csv"), delimiter=";")
    export.to_excel(_t(spark, sf_dir, "region"), str(folder / "r.xlsx"))
    w = Workspace(spark)
    return w.runner.query(f"select cast(max(n_nationkey) as int) as top, count(*) as n from read_csv('{folder}/n.csv', delim = ';') union all select cast(max(r_regionkey) as int), count(*) from read_xlsx('{folder}/r.xlsx')")


# databases: Spark's own copy of an embedded database stands for one, in this process, with its rows in files

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _database() -> str:
    return f"jdbc:derby:{_folder()}/{uuid.uuid4().hex};create=true"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def jdbc_roundtrip_supplier(spark, sf_dir):
    address = _database()
    jdbc.write(_t(spark, sf_dir, "supplier"), address, "SUPPLIER", **DERBY)
    return jdbc.read(spark, address, "SUPPLIER", cap=None, **DERBY)


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 100")
def jdbc_query_with_cap(spark, sf_dir):
    address = _database()
    jdbc.write(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), address, "CUSTOMER", **DERBY)
    return jdbc.read(spark, address, query='select "id", "name" from CUSTOMER order by "id"', cap=100, **DERBY)


@query("SELECT 'NATION' AS name, 2 * count(*) AS n, 3 AS columns FROM nation UNION ALL SELECT 'REGION', count(*), 2 FROM region")
def jdbc_transactions_and_catalog(spark, sf_dir):
    address, nation = _database(), _t(spark, sf_dir, "nation")
    create = 'create table NATION ("n_nationkey" int not null, "n_name" varchar(40), "n_regionkey" int)'
    for how in ("fail", "append"):
        jdbc.write(nation, address, "NATION", how, "STAGE", create=create, types={"n_name": "varchar(40)"}, **DERBY)
    jdbc.write(_t(spark, sf_dir, "region"), address, "REGION", **DERBY)
    return _rows(spark, [(t["name"], t["rows"], len(jdbc.columns(spark, address, t["name"], **DERBY))) for t in jdbc.tables(spark, address, **DERBY)], "name string, n bigint, columns int")


# more of the inherited SQL

sql_query("sql_join_right", "SELECT c_custkey, s_suppkey FROM {customer} RIGHT JOIN {supplier} ON c_custkey = s_suppkey + 140")
sql_query("sql_join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql_query("sql_mode", "SELECT c_nationkey, min(m) AS usual FROM (SELECT c_nationkey, c_mktsegment AS m, count(*) AS k, max(count(*)) OVER (PARTITION BY c_nationkey) AS top FROM {customer} GROUP BY 1, 2) WHERE k = top GROUP BY c_nationkey")
sql_query("sql_nth_value", "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {orders}")
sql_query("sql_map", "SELECT n_nationkey, map('a', n_name, 'b', upper(n_name))['b'] AS b FROM {nation}", "SELECT n_nationkey, upper(n_name) AS b FROM nation")
same_text("surface_columns", "SELECT l_returnflag, min(COLUMNS('l_(quantity|tax)')) FROM {lineitem} GROUP BY l_returnflag")
same_text("surface_replace", "SELECT * REPLACE (upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey) FROM {nation}")
same_text("surface_columns_star", "SELECT COLUMNS(* EXCLUDE (n_name)) + 1 FROM {nation}")
same_text("surface_asof", "SELECT e.event_id, p.value AS last_value FROM {events} e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
same_text("surface_positional", "SELECT a.n_name, b.r_name FROM {nation} a POSITIONAL JOIN {region} b")
same_text("surface_groups", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM {events}")
same_text("surface_union_by_name", "SELECT n_name AS name, n_regionkey AS region FROM {nation} UNION ALL BY NAME SELECT r_regionkey AS region, r_name AS name FROM {region}")
same_text("surface_casts", "SELECT o_orderkey::VARCHAR AS a, CAST(o_totalprice AS DECIMAL(12, 1)) AS b, try_cast(o_orderpriority AS INT) AS c, o_orderdate::DATE AS d FROM {orders}")

# what user SQL asks of operators that follow an order: keys of more than so many rows are cut
same_text("surface_asof_without_key", "SELECT e.event_id, p.value AS last_value FROM {events} e ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY ts) p ON e.ts >= p.ts", bin_rows=1000)
same_text("surface_asof_next", "SELECT e.event_id, e.user_id, p.ts AS next_ts FROM {events} e ASOF JOIN (SELECT DISTINCT user_id, ts FROM {events} WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts < p.ts")
same_text("surface_positional_tables", "SELECT a.n_nationkey, a.n_name, b.s_suppkey, b.s_name FROM {nation} a POSITIONAL JOIN {supplier} b")
same_text("surface_row_numbers", "SELECT c_custkey, row_number() OVER () AS place FROM {customer} WHERE c_custkey % 3 = 1")
same_text("surface_group_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS q9, count(*) AS n FROM {orders} GROUP BY o_orderstatus", bin_rows=500)
same_text("surface_running", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS s, lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM {orders}", bin_rows=1000)
same_text("surface_ranks", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS d FROM {orders}", bin_rows=500)
same_text("surface_interval_join", "SELECT e.event_id, s.user_id, s.low FROM {events} e JOIN (SELECT user_id, date_trunc('day', ts) AS day, min(ts) AS low, max(ts) AS high FROM {events} GROUP BY user_id, date_trunc('day', ts)) s ON e.user_id = s.user_id AND e.ts BETWEEN s.low AND s.high")
same_text("surface_range_join", "SELECT o.o_orderkey, b.part FROM {orders} o JOIN (SELECT p_size AS part, min(p_retailprice) * 100 AS low, max(p_retailprice) * 100 AS high FROM {part} GROUP BY p_size) b ON o.o_totalprice >= b.low AND o.o_totalprice < b.high")

same_text("surface_approximate", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.3 * count(DISTINCT user_id) AS near, count(*) AS n FROM {events} GROUP BY event_type")


@query("SELECT c.name, CAST(count(*) AS BIGINT) AS n, CAST(CASE c.name WHEN 'value' THEN count(value) ELSE count(*) END AS BIGINT) AS filled, true AS distinct_near, true AS middle_near FROM events, (VALUES ('event_id'), ('user_id'), ('value')) c(name) GROUP BY c.name")
def sketches_over_loads(spark, sf_dir):
    """Events in three loads, each sketched and stored by itself; the merged sketches against all rows."""
    events, path = _t(spark, sf_dir, "events"), f"file://{_folder()}/states"
    names = ["event_id", "user_id", "value"]
    for k in range(3):
        sketches.save(sketches.sketch(events.filter(F.col("event_id") % 3 == k), names), path)
    told = {r["name"]: r for r in sketches.estimates(sketches.stored(spark, path)).collect()}
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in names], *[(F.count_if(F.col(c) <= told[c]["quantiles"][1]) / F.count(c)).alias(f"{c}|mid") for c in names], *[(F.count_if(F.col(c) < told[c]["quantiles"][1]) / F.count(c)).alias(f"{c}|below") for c in names]).first()
    near = lambda c: abs(told[c]["distinct_count"] - exact[c]) <= 0.06 * exact[c] + 1
    mid = lambda c: exact[f"{c}|below"] - 0.03 <= 0.5 <= exact[f"{c}|mid"] + 0.03
    return _rows(spark, [(c, told[c]["rows"], told[c]["filled"], near(c), mid(c)) for c in names], "name string, n bigint, filled bigint, distinct_near boolean, middle_near boolean")


@query("SELECT 0 AS version, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders UNION ALL SELECT 1, count(*), CAST(sum(CASE WHEN o_orderkey % 1000 = 0 THEN 0 ELSE o_custkey END) AS BIGINT) FROM orders UNION ALL SELECT 2, count(*) FILTER (o_orderstatus <> 'P'), CAST(sum(CASE WHEN o_orderkey % 1000 = 0 THEN 0 ELSE o_custkey END) FILTER (o_orderstatus <> 'P') AS BIGINT) FROM orders")
def workspace_versions(spark, sf_dir):
    """Each change of a table is a version, and earlier ones stay readable."""
    w = _space(spark, sf_dir, "orders")
    for sql in ("update orders set o_custkey = 0 where o_orderkey % 1000 = 0", "delete from orders where o_orderstatus = 'P'"):
        got = w.run_sql(sql)
        assert got["ok"], got
    each = [w.version("orders", k).agg(F.lit(k).alias("version"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s")) for k in range(3)]
    return each[0].union(each[1]).union(each[2])
