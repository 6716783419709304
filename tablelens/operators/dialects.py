"""How each database names types and quotes identifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Reserved words of Transact-SQL, as its documentation lists them.
TSQL_RESERVED = frozenset("""
ADD ALL ALTER AND ANY AS ASC AUTHORIZATION BACKUP BEGIN BETWEEN BREAK BROWSE BULK BY CASCADE CASE CHECK CHECKPOINT CLOSE
CLUSTERED COALESCE COLLATE COLUMN COMMIT COMPUTE CONSTRAINT CONTAINS CONTAINSTABLE CONTINUE CONVERT CREATE CROSS CURRENT
CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER CURSOR DATABASE DBCC DEALLOCATE DECLARE DEFAULT DELETE DENY DESC
DISK DISTINCT DISTRIBUTED DOUBLE DROP DUMP ELSE END ERRLVL ESCAPE EXCEPT EXEC EXECUTE EXISTS EXIT EXTERNAL FETCH FILE
FILLFACTOR FOR FOREIGN FREETEXT FREETEXTTABLE FROM FULL FUNCTION GOTO GRANT GROUP HAVING HOLDLOCK IDENTITY
IDENTITY_INSERT IDENTITYCOL IF IN INDEX INNER INSERT INTERSECT INTO IS JOIN KEY KILL LEFT LIKE LINENO LOAD MERGE NATIONAL
NOCHECK NONCLUSTERED NOT NULL NULLIF OF OFF OFFSETS ON OPEN OPENDATASOURCE OPENQUERY OPENROWSET OPENXML OPTION OR ORDER
OUTER OVER PERCENT PIVOT PLAN PRECISION PRIMARY PRINT PROC PROCEDURE PUBLIC RAISERROR READ READTEXT RECONFIGURE
REFERENCES REPLICATION RESTORE RESTRICT RETURN REVERT REVOKE RIGHT ROLLBACK ROWCOUNT ROWGUIDCOL RULE SAVE SCHEMA
SECURITYAUDIT SELECT SEMANTICKEYPHRASETABLE SEMANTICSIMILARITYDETAILSTABLE SEMANTICSIMILARITYTABLE SESSION_USER SET
SETUSER SHUTDOWN SOME STATISTICS SYSTEM_USER TABLE TABLESAMPLE TEXTSIZE THEN TO TOP TRAN TRANSACTION TRIGGER TRUNCATE
TRY_CONVERT TSEQUAL UNION UNIQUE UNPIVOT UPDATE UPDATETEXT USE USER VALUES VARYING VIEW WAITFOR WHEN WHERE WHILE WITH
WITHIN WRITETEXT
""".split())
# Further words that ODBC reserves, as the same documentation lists them.
ODBC_RESERVED = frozenset("""
ABSOLUTE ACTION ADA ALLOCATE ARE ASSERTION AT AVG BIT BIT_LENGTH BOTH CASCADED CAST CATALOG CHAR CHAR_LENGTH CHARACTER CHARACTER_LENGTH
COLLATION CONNECT CONNECTION CONSTRAINTS CORRESPONDING COUNT DATE DAY DEC DECIMAL DEFERRABLE DEFERRED DESCRIBE DESCRIPTOR DIAGNOSTICS
DISCONNECT DOMAIN EXCEPTION EXTRACT FALSE FIRST FLOAT FORTRAN FOUND GET GLOBAL GO HOUR IMMEDIATE INCLUDE INDICATOR INITIALLY INPUT
INSENSITIVE INT INTEGER INTERVAL ISOLATION LANGUAGE LAST LEADING LEVEL LOCAL LOWER MATCH MAX MIN MINUTE MODULE MONTH NAMES NATURAL NCHAR
NEXT NO NONE NUMERIC OCTET_LENGTH ONLY OUTPUT OVERLAPS PAD PARTIAL PASCAL POSITION PREPARE PRESERVE PRIOR PRIVILEGES REAL RELATIVE ROWS
SCROLL SECOND SECTION SESSION SIZE SMALLINT SPACE SQL SQLCA SQLCODE SQLERROR SQLSTATE SQLWARNING SUBSTRING SUM TEMPORARY TIME TIMESTAMP
TIMEZONE_HOUR TIMEZONE_MINUTE TRAILING TRANSLATE TRANSLATION TRIM TRUE UNKNOWN UPPER USAGE USING VALUE VARCHAR WHENEVER WORK WRITE YEAR ZONE
""".split())
# Keywords that a query engine of the DuckDB or Spark family reads as syntax.
SQL_RESERVED = frozenset("ALL AND ANY ARRAY AS ASC BOTH CASE CAST CHECK COLLATE COLUMN CONSTRAINT CREATE DEFAULT DESC DISTINCT DO ELSE END EXCEPT FALSE FETCH FOR FOREIGN FROM GRANT GROUP HAVING IN INTERSECT INTO LATERAL LEADING LIMIT NOT NULL OFFSET ON ONLY OR ORDER PRIMARY QUALIFY REFERENCES SELECT SOME SUMMARIZE TABLE THEN TO TRAILING TRUE UNION UNIQUE USING VARIADIC WHEN WHERE WINDOW WITH".split())

INT_RANGES = ((0, 255), (-(2**15), 2**15 - 1), (-(2**31), 2**31 - 1), (-(2**63), 2**63 - 1))
_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Numbers:
    """A numeric column: kind is int, decimal or fallback."""

    kind: str
    low: int = 0
    high: int = 0
    precision: int = 1
    scale: int = 0


@dataclass(frozen=True)
class Stamps:
    sub_millisecond: bool = False
    before_1753: bool = False
    midnight_only: bool = False


@dataclass(frozen=True)
class Texts:
    shortest: int = 1
    longest: int = 1

    @property
    def fixed(self) -> bool:
        return self.shortest == self.longest


NO_TEXTS = Texts(0, 1)


class Dialect:
    id = "duckdb"
    label = "DuckDB"
    ints = ("tinyint", "smallint", "integer", "bigint")
    decimal = "decimal({p}, {s})"
    names = {"boolean": "boolean", "date": "date", "time": "time", "uuid": "uuid", "fallback": "double", "unknown": "varchar"}
    quotes = ('"', '"')
    reserved = SQL_RESERVED
    any_boolean = True

    def quote(self, name: str) -> str:
        a, b = self.quotes
        return name if _BARE.fullmatch(name) and name.upper() not in self.reserved else a + name.replace(b, b + b) + b

    def integer(self, low: int, high: int) -> str | None:
        """The narrowest type that holds the range, if any does."""
        return next((t for t, (a, b) in zip(self.ints, INT_RANGES, strict=True) if a <= low and high <= b), None)

    def number(self, n: Numbers) -> str:
        if n.kind == "fallback":
            return self.names["fallback"]
        if n.kind == "int":
            if fits := self.integer(n.low, n.high):
                return fits
            return self.decimal.format(p=min(38, max(1, len(str(max(abs(n.low), abs(n.high)))))), s=0)
        return self.decimal.format(p=min(n.precision, 38), s=n.scale)

    def stamp(self, s: Stamps) -> str:
        return self.names["date"] if s.midnight_only else "timestamp"

    def text(self, t: Texts) -> str:
        return "varchar"

    def binary(self, longest: int | None) -> str:
        return "blob"


class SqlServer(Dialect):
    id = "sqlserver"
    label = "SQL Server"
    ints = ("tinyint", "smallint", "int", "bigint")
    names = {"boolean": "bit", "date": "date", "time": "time", "uuid": "uniqueidentifier", "fallback": "decimal(38, 10)", "unknown": "nvarchar(max)"}
    quotes = ("[", "]")
    reserved = TSQL_RESERVED | ODBC_RESERVED
    any_boolean = False

    def stamp(self, s: Stamps) -> str:
        if s.midnight_only:
            return "date"
        return "datetime2" if s.sub_millisecond or s.before_1753 else "datetime"

    def text(self, t: Texts) -> str:
        n = max(1, t.longest)
        return f"char({n})" if t.fixed and n <= 8 else f"varchar({n})"

    def binary(self, longest: int | None) -> str:
        return f"varbinary({longest})" if longest and 0 < longest <= 8000 else "varbinary(max)"


class Spark(Dialect):
    id = "spark"
    label = "Apache Spark"
    ints = ("smallint", "smallint", "int", "bigint")
    names = {"boolean": "boolean", "date": "date", "time": "string", "uuid": "string", "fallback": "double", "unknown": "string"}
    quotes = ("`", "`")

    def stamp(self, s: Stamps) -> str:
        return "date" if s.midnight_only else "timestamp_ntz"

    def text(self, t: Texts) -> str:
        return "string"

    def binary(self, longest: int | None) -> str:
        return "binary"


DIALECTS: dict[str, Dialect] = {d.id: d for d in (Dialect(), SqlServer(), Spark())}


def dialect(name: str) -> Dialect:
    if name not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}; known: {', '.join(DIALECTS)}")
    return DIALECTS[name]
