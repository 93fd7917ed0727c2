"""Micro-batches of JSON batch files through the same operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..plans.pipeline import Pipeline
from ..operators.numbering import with_running
from ..sources.shared import stash


def ingest_stream(pipeline: Pipeline, folder: str, checkpoint: str, as_of: datetime) -> StreamingQuery:
    """Ingests JSON-lines candidates that arrive in ``folder``; each micro-batch is one ingest, in the order of the
    files' times and names and of the lines. Repeated rows count as duplicates. A batch that is
    repeated after a crash finds its rows in the store and saves none; its events are sent again, with counts of
    duplicates."""
    spark = pipeline.spark
    files = spark.readStream.schema(schema.CANDIDATE).json(folder)
    rows = files.select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def handle(batch: DataFrame, epoch: int) -> None:
        # lines of one block of a file follow each other in one task
        lines = stash(batch.withColumn("line", F.monotonically_increasing_id()))
        candidates = stash(with_running(lines, ["file_time", "file", "at", "line"], pos=F.lit(1)).drop("file_time", "file", "at", "line"))
        known = stash(candidates.select("publisherCode", "publisherName").distinct())
        none = F.lit(None).cast("string")
        status = known.select("publisherCode", "publisherName", F.lit(True).alias("success"), none.alias("errorType"), none.alias("errorMessage"))
        pipeline.save(epoch, candidates, status, as_of)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
