"""Tables and queries of a database over JDBC.

Tasks connect to a database by themselves. An embedded one (Derby) is in the driver's process, where tasks of a cluster cannot reach it: there
rows go by files in the shared folder, which tasks write and the database imports one at a time, or the database exports and tasks read.
"""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import drop, work_dir

ROW_CAP, FETCH = 1_000_000, 5_000
URLS = {"sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt={encrypt};trustServerCertificate={trust}", "postgresql": "jdbc:postgresql://{host}:{port}/{database}"}
PORTS = {"sqlserver": 1433, "postgresql": 5432}
CATALOG = {
    "databases": "select name from sys.databases where state = 0",
    "schemas": "select name from sys.schemas",
    "tables": "select s.name as table_schema, t.name as table_name, t.type_desc as table_type from sys.objects t join sys.schemas s on s.schema_id = t.schema_id where t.type in ('U', 'V')",
}


def url(kind: str, host: str, database: str = "", port: int | None = None, encrypt: bool = True, trust: bool = False) -> str:
    if kind not in URLS:
        raise ValueError(f"unknown database {kind!r}; known: {', '.join(URLS)}")
    return URLS[kind].format(host=host, port=port or PORTS[kind], database=database, encrypt=str(encrypt).lower(), trust=str(trust).lower())


def _apart(spark: SparkSession, address: str) -> bool:
    """Whether the database is in the driver's process and tasks are not."""
    return re.match(r"jdbc:derby:(?!//)", address) is not None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master)


def _checked(schema: T.StructType) -> None:
    """Files hold what is text, a number, a date or a time."""
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType | T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType):
            raise ValueError(f"{f.name}: no {f.dataType.simpleString()} by way of files")


def _imported(df: DataFrame, address: str, table: str, **properties: str) -> None:
    """Fills a table of the driver's database with files that tasks write; the driver has one of them at a time, and all or none are committed."""
    spark = df.sparkSession
    _checked(df.schema)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    shown = [quoted(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields]
    path = work_dir(spark)
    df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in shown])).write.text(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema, name = ([None, *table.split(".")])[-2:]
    try:
        with tempfile.TemporaryDirectory(prefix="tablelens-") as own, connected(spark, address, **properties) as c:
            call = c.prepareCall("call SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, null, ?, ',', '\"', 'UTF-8', 0)")
            for i, part in enumerate(sorted(s.getPath().toString() for s in store.listStatus(where) if s.getPath().getName().startswith("part-") and s.getLen())):
                here = f"{own}/{i}"
                store.copyToLocalFile(spark._jvm.org.apache.hadoop.fs.Path(part), spark._jvm.org.apache.hadoop.fs.Path(f"file://{here}"))
                for at, value in enumerate((schema and schema.upper(), name.strip('"') if name.startswith('"') else name.upper(), ",".join(df.columns), here), 1):
                    call.setString(at, value)
                call.execute()
                Path(here).unlink()
    finally:
        drop(spark, path)


def _exported(spark: SparkSession, address: str, text: str, schema: T.StructType, **properties: str) -> DataFrame:
    """A query of the driver's database as rows that tasks read: the database writes a file, which goes to the shared folder."""
    _checked(schema)
    path = work_dir(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    with tempfile.TemporaryDirectory(prefix="tablelens-") as own, connected(spark, address, **properties) as c:
        call = c.prepareCall("call SYSCS_UTIL.SYSCS_EXPORT_QUERY(?, ?, ',', '\"', 'UTF-8')")
        call.setString(1, text)
        call.setString(2, f"{own}/rows")
        call.execute()
        store.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{own}/rows"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows"))
    texts = spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])).csv(path, quote='"', escape='"', multiLine=True, mode="FAILFAST", encoding="UTF-8", lineSep="\n", nullValue="\0null\0", emptyValue="")
    return texts.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read(spark: SparkSession, address: str, table: str | None = None, query: str | None = None, cap: int | None = ROW_CAP, split: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """A table or query of at most cap rows. split: a numeric column, its range, and how many tasks read parts of it at once."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    reader = spark.read.format("jdbc").option("url", address).option("fetchsize", FETCH).options(**properties)
    reader = reader.option("dbtable", table if table else f"({query.rstrip().rstrip(';')}) q")
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    df = reader.load()
    if _apart(spark, address):
        source = f"({query.rstrip().rstrip(';')}) q" if query else table
        return _exported(spark, address, f"select * from {source}" + ("" if cap is None else f" fetch first {int(cap)} rows only"), df.schema, **properties)
    return df if cap is None else df.limit(cap)


def catalog(spark: SparkSession, address: str, what: str, **properties: str) -> DataFrame:
    """databases, schemas or tables by SQL Server's own views."""
    return read(spark, address, query=CATALOG[what], cap=None, **properties)


@contextmanager
def connected(spark: SparkSession, address: str, **properties: str):
    """A connection of the driver, whose statements are committed together or not at all."""
    settings = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            settings.setProperty(k, v)
    if "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(address, settings)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _each(result, *names: str) -> list[tuple]:
    out: list[tuple] = []
    while result.next():
        out.append(tuple(result.getString(n) for n in names))
    result.close()
    return out


def tables(spark: SparkSession, address: str, counts: bool = True, **properties: str) -> list[dict]:
    """Tables and views of any database by its driver's metadata, with their rows."""
    with connected(spark, address, **properties) as c:
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        found = _each(c.getMetaData().getTables(None, None, "%", kinds), "TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE")
        quote = c.getMetaData().getIdentifierQuoteString().strip() or '"'
        out = []
        for schema, name, kind in found:
            rows = None
            if counts:
                whole = ".".join(f"{quote}{x}{quote}" for x in (schema, name) if x)
                ((n,),) = _each(c.createStatement().executeQuery(f"select count(*) as n from {whole}"), "N")
                rows = int(n)
            out.append({"schema": schema, "name": name, "type": kind.lower(), "rows": rows})
    return out


def columns(spark: SparkSession, address: str, table: str, **properties: str) -> list[dict]:
    """The columns of a table, in order. Names are compared whatever their case."""
    with connected(spark, address, **properties) as c:
        found = _each(c.getMetaData().getColumns(None, None, "%", "%"), "TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "IS_NULLABLE")
    return [{"name": n, "type": t.lower(), "size": int(size), "nullable": null == "YES"} for owner, n, t, size, null in found if owner.lower() == table.lower()]


def write(df: DataFrame, address: str, table: str, if_exists: str = "fail", staging: str | None = None, batch: int = 20_000, create: str | None = None, types: dict[str, str] | None = None, **properties: str) -> int:
    """fail, drop or append; the rows written. Spark commits by partition, so that a failure may leave some rows.

    With staging, rows go to that table first, and one transaction of the driver drops, creates and fills the table: all or nothing. create
    is the statement that makes the table where there is none, types what its columns are cast to.
    """
    mode = {"fail": "error", "drop": "overwrite", "append": "append"}[if_exists]
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))

    def put(name: str, how: str) -> None:
        apart = _apart(df.sparkSession, address)
        (df.limit(0) if apart else rows).write.format("jdbc").option("url", address).option("batchsize", batch).options(**properties).option("dbtable", name).mode(how).save()
        if apart:  # Spark has made the table
            _imported(rows, address, name, **properties)

    if staging is None:
        put(table, mode)
        return int(seen.get["n"])
    there = any(t["name"].lower() == table.lower() for t in tables(df.sparkSession, address, counts=False, **properties))
    if there and if_exists == "fail":
        raise ValueError(f"{table} exists")
    if not create and (not there or if_exists == "drop"):
        raise ValueError(f"say how to create {table}")
    put(staging, "overwrite")
    names = ", ".join(f'"{c}"' for c in df.columns)
    values = ", ".join(f'cast("{c}" as {types[c]})' if types and c in types else f'"{c}"' for c in df.columns)
    steps = [f"drop table {table}"] if there and if_exists == "drop" else []
    steps += [create] if create and (not there or if_exists == "drop") else []
    steps += [f"insert into {table} ({names}) select {values} from {staging}"]
    try:
        with connected(df.sparkSession, address, **properties) as c:
            for step in steps:
                c.createStatement().execute(step.strip().rstrip(";"))
    finally:
        with connected(df.sparkSession, address, **properties) as c:
            c.createStatement().execute(f"drop table {staging}")
    return int(seen.get["n"])
