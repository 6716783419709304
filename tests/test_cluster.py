"""What holds only where executors are other processes than the driver."""

import os
import subprocess
import sys
from pathlib import Path

RUN = r"""
import datetime as dt, sys
from pyspark.sql import functions as F
from tablelens.session import session
from tablelens.sources import jdbc

spark = session("local-cluster[2,1,1024]", **{"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.sql.warehouse.dir": f"{sys.argv[1]}/wh"})
spark.sparkContext.setLogLevel("OFF")
derby = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
address = f"jdbc:derby:{sys.argv[1]}/db;create=true"
day = dt.datetime(2024, 2, 3, 4, 5, 6, 70)
rows = [(1, ' a "b", c ', 1.5, day), (2, None, None, None), (3, "", -1e-300, dt.datetime(1969, 12, 31)), (4, "two\nlines\r\n", 2.0**60, day)]
df = spark.createDataFrame(rows, "id long, name string, share double, at timestamp_ntz").repartition(3)
assert jdbc.write(df, address, "PLAIN", **derby) == 4
got = sorted(map(tuple, jdbc.read(spark, address, "PLAIN", cap=None, **derby).collect()))
assert got == rows, got
assert [r[0] for r in jdbc.read(spark, address, query='select "id" from PLAIN order by "id" desc;', cap=3, **derby).collect()] == [4, 3, 2]
assert jdbc.write(df.filter("id < 3"), address, "PLAIN", "append", **derby) == 2
assert [t["rows"] for t in jdbc.tables(spark, address, **derby)] == [6]
try:
    jdbc.write(df, address, "PLAIN", **derby)
    raise SystemExit("an existing table was filled")
except Exception as e:
    assert "exists" in str(e), e
create = 'create table TYPED ("id" bigint not null, "name" varchar(4))'
assert jdbc.write(df.filter("id = 2").select("id", "name"), address, "TYPED", staging="STAGE", create=create, **derby) == 1
assert sorted((t["name"], t["rows"]) for t in jdbc.tables(spark, address, **derby)) == [("PLAIN", 6), ("TYPED", 1)]
print("all right")
"""


def test_embedded_database_of_the_driver(tmp_path):
    root = str(Path(__file__).parents[1])
    got = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("all right"), got.stderr[-2000:]
