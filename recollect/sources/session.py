"""Sessions and stores."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import SQL, role

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
SCHEMA_VERSION = 23


def open_session(name: str = "recollect", **settings: str) -> SparkSession:
    """A session with the engine's settings; an active one is used as it is."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views of all roles, the probe-free ones among them."""
    for name in SQL:
        role(spark, sf_dir, name).createOrReplaceTempView(name)
    return list(SQL)


def check_schema_version(found: int) -> None:
    if found != SCHEMA_VERSION:
        raise ValueError(f"schema version {found}, expected {SCHEMA_VERSION}")
