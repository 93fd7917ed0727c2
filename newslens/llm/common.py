"""Shared helpers: tables, whitespace words, and intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, release, shared_dir, stash

__all__ = ["WS", "bounded_batches", "double_array", "drop", "let", "long_array", "release", "shared_dir", "spaced", "stash", "table", "words"]

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
WS = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to Python and back, at most: texts are long, and both sides hold a batch several times over.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python have BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spaced(text: Column) -> Column:
    """The text with every white-space character as one blank, empty for null; plain byte searches, no regex."""
    out = F.coalesce(text, F.lit(""))
    for c in WS[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Array of the maximal runs outside :data:`WS`; empty for null or blank text."""
    return F.array_remove(F.split(spaced(text), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once; lambda bodies would otherwise evaluate it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>, folded to one literal however long it is."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def double_array(values: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")
