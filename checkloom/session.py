"""Session defaults."""

from pyspark.sql import SparkSession


def session(name: str = "checkloom", **extra: str) -> SparkSession:
    """A session with AQE on, UTC times, and ANSI off: value arithmetic wraps around as on the analysed platform."""
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=conf | extra).getOrCreate()
