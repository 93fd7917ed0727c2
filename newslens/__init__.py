"""newslens: Spark-first news ingestion, de-duplication, topic clustering and read models."""

__version__ = "0.1.0"

from pathlib import Path as _Path

from pyspark.sql import SparkSession as _SparkSession


def on_workers(spark: _SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they see that folder.

    On a cluster whose machines don't share it, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    here = str(_Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (here, env.get("PYTHONPATH", "")) if p)


def register(spark: _SparkSession) -> None:
    """``tokenize`` and ``normalize_url`` as functions of the session's SQL."""
    from .functions import text, url

    on_workers(spark)
    spark.udf.register("tokenize", text.sql_tokenize)
    spark.udf.register("normalize_url", url.sql_normalize_url)
