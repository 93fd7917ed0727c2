"""The run's events as an append-only table, to be read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import Event, EventBus

SCHEMA = "run_id long, seq long, step string, status string, message string, progress int, target string, error string"


class EventTable:
    """A listener that appends each event as a row of ``path``; ``seq`` counts a run's events from 0.

    An event is written when it is published, so that a reader of the stream follows the run. A run's events come from
    its driver alone; a table that is opened again goes on after the last stored number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._next: dict[int, int] = {}

    def _number(self, run_id: int) -> int:
        if run_id not in self._next:
            last = self.read().where(F.col("run_id") == run_id).agg(F.max("seq").alias("n")).first()["n"]
            self._next[run_id] = 0 if last is None else last + 1
        n = self._next[run_id]
        self._next[run_id] = n + 1
        return n

    def __call__(self, event: Event) -> None:
        row = (event.run_id, self._number(event.run_id), event.step, event.status, event.message, event.progress, event.target, event.error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def listen(self, bus: EventBus) -> None:
        """Makes the table, so that a stream can start before the first event, and registers it."""
        self.spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)
        bus.register(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stream(self) -> DataFrame:
        """The events as they come; (run_id, seq) is their order."""
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)
