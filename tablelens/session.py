"""A session with the settings whose semantics the workbench relies on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: User SQL: division by zero and failed casts give null, timestamps have no zone.
SQL_SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tablelens")
    if master:
        builder = builder.master(master)
    for k, v in (SQL_SETTINGS | conf).items():
        builder = builder.config(k, v)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


#: Rows that a statement may make by calling itself; any number.
RECURSION_ROWS = {"spark.sql.cteRecursionRowLimit": "-1"}


@contextmanager
def recursion(spark: SparkSession) -> Iterator[None]:
    """No bound on a recursion's rows for what is run within; that on its levels stays, so that one without an end is told."""
    before = {k: spark.conf.get(k) for k in RECURSION_ROWS}
    for k, v in RECURSION_ROWS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def semantics(spark: SparkSession) -> Iterator[None]:
    """The settings for what is analysed or run within; a session made elsewhere gets its own back."""
    before = {k: spark.conf.get(k) for k in SQL_SETTINGS}
    configure(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
