"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_stashed: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where that is unset and one machine does all the work, a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = of_context.get() if of_context.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage is cut and
    a lost executor costs only a re-read. The table is deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newslens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stashed:
        atexit.register(_drop_all)
    _stashed.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a stashed table that no later plan reads."""
    files = df.inputFiles()
    for spark, path in list(_stashed):
        if files and path.split("/")[-1] in files[0]:
            _delete(spark, path)
            _stashed.remove((spark, path))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of plans that nobody holds any more, which it does when the
    driver collects its garbage: a driver that plans many rounds would else keep those of all of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _stashed:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the cluster's own clean-up of the folder remains
            return
