"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: For sessions that run SQL from outside: quoted names are names, and paths are no tables.
SQL_SETTINGS = {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """The current session, or a new one with ``SETTINGS``; ``conf`` comes on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def isolated(spark: SparkSession) -> SparkSession:
    """A session with its own catalog of views, for SQL from outside."""
    own = spark.newSession()
    for k, v in SQL_SETTINGS.items():
        own.conf.set(k, v)
    return own
