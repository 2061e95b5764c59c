"""Databases over JDBC: a connection test and the columns of a query, with errors that name no secret."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .guard import dialect_of, read_only, redacted

# What asks a database who it takes the caller for, in its dialect.
IDENTITY = {
    "postgresql": "SELECT current_user AS who, current_database() AS place", "mssql": "SELECT SUSER_SNAME() AS who, DB_NAME() AS place", "oracle": "SELECT USER AS who, SYS_CONTEXT('USERENV', 'DB_NAME') AS place FROM dual",
    "mysql": "SELECT CURRENT_USER() AS who, DATABASE() AS place", "databricks": "SELECT current_user() AS who, current_catalog() AS place",
}
PLAIN = "SELECT CURRENT_USER AS who FROM (VALUES (1)) AS t(one)"  # standard SQL, for any other


@dataclass(frozen=True)
class Tested:
    ok: bool
    who: str | None = None
    place: str | None = None
    error: str | None = None


def _said(error: Exception) -> str:
    """The first line of what went wrong, without passwords."""
    text = str(getattr(error, "java_exception", None) or error)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return redacted(lines[0] if lines else type(error).__name__)


def _load(spark: SparkSession, jdbc: dict, query: str):
    return spark.read.format("jdbc").options(**{k: v for k, v in jdbc.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}).option("query", query).load()


def test_connection(spark: SparkSession, jdbc: dict, dialect: str | None = None) -> Tested:
    """Who the database takes the caller for, or why it doesn't answer.  Asks for one row, in one task."""
    dialect = dialect or dialect_of(jdbc.get("url", ""))
    try:
        row = _load(spark, jdbc, IDENTITY.get(dialect, PLAIN)).first()
    except Exception as e:  # whatever the driver throws is the answer
        return Tested(False, error=_said(e))
    values = [None if v is None else str(v).strip() for v in row]
    return Tested(True, values[0], values[1] if len(values) > 1 else None)


def query_columns(spark: SparkSession, jdbc: dict, query: str, dialect: str | None = None) -> list[tuple[str, str]]:
    """(name, type) of a query's columns.  Spark asks the database for them alone: no row is read."""
    return _load(spark, jdbc, read_only(query, dialect or dialect_of(jdbc.get("url", "")))).dtypes
