"""The session and the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str | None = None, more: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("plumbline").config(map=SETTINGS | (more or {}))
    return (builder.master(master) if master else builder).getOrCreate()
