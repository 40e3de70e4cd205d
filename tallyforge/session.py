"""Sessions with the settings that results rely on."""

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps and adaptive plans; any other setting is the caller's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
