"""Daily counts that add up: dashboard figures without a scan of the rows.

A day is closed at both ends, so that a row of exactly midnight belongs to two days: next to a day's rows the counts
keep how many of them are of its first instant, which the day before counts too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .read import last_collected

#: Counted tables: the column of the time and that of the name by which they are counted.
COUNTED = {"article": ("fetched_at", "publisher_id"), "topic": ("created_at", "status"), "pipeline_step_history": ("started_at", "status")}


def partial_counts(source: str, rows: DataFrame) -> DataFrame:
    """source, day, name, n and at_midnight of the rows of one append; null times are not counted by day."""
    at, name = COUNTED[source]
    day = F.to_date(at)
    first = F.col(at).cast("timestamp_ntz") == day.cast("timestamp_ntz")
    return rows.groupBy(day.alias("day"), F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n"), F.count_if(first).alias("at_midnight")).where("day IS NOT NULL").select(F.lit(source).alias("source"), "day", "name", "n", "at_midnight")


def retracted(counts: DataFrame) -> DataFrame:
    """The counts of rows that are gone."""
    return counts.withColumns({"n": -F.col("n"), "at_midnight": -F.col("at_midnight")})


def on_day_by_name(counts: DataFrame, source: str, day: str) -> DataFrame:
    """name and n of the source's rows of the day."""
    d = F.lit(day).cast("date")
    n = F.when(F.col("day") == d, F.col("n")).otherwise(F.col("at_midnight"))
    found = counts.where((F.col("source") == source) & F.col("day").between(d, F.date_add(d, 1)))
    return found.groupBy("name").agg(F.sum(n).alias("n")).where("n > 0")


def summary(counts: DataFrame, runs: DataFrame, day: str) -> DataFrame:
    """:func:`dashboard.summary` from counts; the newest runs are read."""
    total = lambda source, name: on_day_by_name(counts, source, day).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("n"))), F.lit(0))
    steps = on_day_by_name(counts, "pipeline_step_history", day).agg(of("SUCCESS", "PARTIAL_FAILED").alias("success_jobs"), of("FAILED", "PARTIAL_FAILED").alias("failed_jobs"))
    a = total("article", "total_articles").withColumn("today_collected_articles", F.col("total_articles"))
    return a.join(total("topic", "total_topics"), how="cross").join(steps, how="cross").join(last_collected(runs), how="cross")  # one row each


def articles_by_publisher(counts: DataFrame, publishers: DataFrame) -> DataFrame:
    """:func:`dashboard.articles_by_publisher` from counts; publishers (id, name)."""
    n = counts.where("source = 'article'").groupBy("name").agg(F.sum("n").alias("n")).where("n > 0")
    named = n.join(publishers.select(F.col("id").cast("string").alias("name"), F.col("name").alias("publisher_name")), "name")
    return named.groupBy("publisher_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "publisher_name")


def status_histogram(counts: DataFrame, day: str) -> DataFrame:
    """:func:`dashboard.status_histogram` of a day from counts."""
    n = on_day_by_name(counts, "pipeline_step_history", day).withColumnRenamed("name", "status")
    all_ = counts.sparkSession.createDataFrame(list(enumerate(schema.RUN_STATUSES)), "place int, status string")
    return all_.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")
