"""Dashboard: summary counts and charts. Only some figures depend on the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .numbering import with_running
from .read import history_rows, last_collected, newest, on_day

#: Links of one part of the topics, about.
LINKS_OF_PART = 500_000


def summary(articles: DataFrame, topics: DataFrame, steps: DataFrame, runs: DataFrame, day: str) -> DataFrame:
    """One row: the day's articles (by fetched_at), topics (by created_at) and successful and failed steps
    (PARTIAL_FAILED counts as both); last_collected_at is of all time."""
    a = articles.where(on_day(F.col("fetched_at"), day)).agg(F.count("*").alias("total_articles"))
    t = topics.where(on_day(F.col("created_at"), day)).agg(F.count("*").alias("total_topics"))
    s = steps.where(on_day(F.col("started_at"), day)).agg(
        F.count_if(F.col("status").isin("SUCCESS", "PARTIAL_FAILED")).alias("success_jobs"),
        F.count_if(F.col("status").isin("FAILED", "PARTIAL_FAILED")).alias("failed_jobs"),
    )
    # one row each
    return a.withColumn("today_collected_articles", F.col("total_articles")).join(t, how="cross").join(s, how="cross").join(last_collected(runs), how="cross")


def recent_steps(steps: DataFrame) -> DataFrame:
    """The ten newest steps of all days."""
    return newest(steps)


def full_summary(articles: DataFrame, topics: DataFrame, steps: DataFrame, runs: DataFrame, day: str) -> DataFrame:
    """:func:`summary` with recent_runs, the ten newest steps of all days with their runs' counts, newest first."""
    return with_recent(summary(articles, topics, steps, runs, day), steps, runs)


def with_recent(figures: DataFrame, steps: DataFrame, runs: DataFrame) -> DataFrame:
    """The row of figures with recent_runs."""
    items = history_rows(newest(steps), runs)
    one = F.struct("started_at", "id", *[c for c in items.columns if c not in ("started_at", "id")])
    recent = items.agg(F.sort_array(F.collect_list(one), asc=False).alias("recent_runs"))  # ten at most
    return figures.join(recent, how="cross")


def charts(articles: DataFrame, links: DataFrame, topics: DataFrame, linked: DataFrame, steps: DataFrame, day: str) -> DataFrame:
    """chart, place, name and n: articles by publisher and topics by country of all times, and the day's steps by status."""
    parts = []
    for chart, rows in (
        ("articlesByPublisher", articles_by_publisher(articles).toDF("name", "n")), ("topicsByCountry", topics_by_country(links, topics, linked).toDF("name", "n")),
        ("pipelineStatusCounts", status_histogram(steps, day).toDF("name", "n")),
    ):
        first = F.array_position(F.array(*map(F.lit, schema.RUN_STATUSES)), F.col("name")) if chart == "pipelineStatusCounts" else -F.col("n")
        parts.append(with_running(rows, [first, F.col("name")], place=F.lit(1)).select(F.lit(chart).alias("chart"), "place", "name", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def articles_by_publisher(articles: DataFrame) -> DataFrame:
    return articles.groupBy("publisher_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "publisher_name")


def topics_by_country(links: DataFrame, topics: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct topics of any status by the country of a linked article's publisher.

    Links are dealt by article, then by topic, into parts whose number grows with the links, so that a task's memory doesn't; links are
    (topic, country) once before they meet their topics.
    """
    parts = max(1, -(-links.count() // LINKS_OF_PART))
    t = topics.select(F.col("id").alias("topic_id")).repartition(parts, "topic_id")
    a = articles.select(F.col("id").alias("article_id"), "country")
    pairs = links.select("topic_id", "article_id").repartition(parts, "article_id").join(a, "article_id").select("topic_id", "country")
    each = pairs.repartition(parts, "topic_id").distinct().join(t, "topic_id", "left_semi")
    return each.groupBy("country").agg(F.count("topic_id").alias("n")).orderBy(F.desc("n"), "country")


def status_histogram(steps: DataFrame, day: str | None = None) -> DataFrame:
    """Every status in order with its number of steps, 0 included."""
    if day:
        steps = steps.where(on_day(F.col("started_at"), day))
    all_ = steps.sparkSession.range(len(schema.RUN_STATUSES)).select(
        F.col("id").alias("place"), F.get(F.array(*[F.lit(s) for s in schema.RUN_STATUSES]), F.col("id").cast("int")).alias("status")
    )
    n = steps.groupBy("status").agg(F.count("*").alias("n"))
    return all_.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")
