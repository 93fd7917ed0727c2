"""Read models: filters, sorts, paging, joins and per-topic summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound
from ..functions.text import tokenize
from .numbering import with_running

__all__ = ["NotFound"]


def contains_ignoring_case(x: Column, part: str) -> Column:
    """Literal substring match; ``%`` and ``_`` mean themselves."""
    return F.contains(F.upper(x), F.upper(F.lit(part)))


def on_day(x: Column, day: str, half_open: bool = False) -> Column:
    """From the day's midnight to the next one, which counts too unless ``half_open``."""
    start = F.lit(day).cast("timestamp_ntz")
    end = start + F.expr("INTERVAL 1 DAY")
    return (x >= start) & (x < end) if half_open else x.between(start, end)


def since(x: Column, as_of: str, hours: int) -> Column:
    """At most ``hours`` (1 to 168) before ``as_of``."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be from 1 to 168")
    return x >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))


def list_articles(articles: DataFrame, headline: str | None = None, day: str | None = None) -> DataFrame:
    """Newest first; articles without a date last."""
    if headline:
        articles = articles.where(contains_ignoring_case(F.col("headline"), headline))
    if day:
        articles = articles.where(on_day(F.col("published_at"), day))
    return articles.orderBy(F.desc_nulls_last("published_at"), F.desc("id"))


def list_topics(topics: DataFrame, status: str | None = None, day: str | None = None) -> DataFrame:
    if status:
        topics = topics.where(F.col("status") == status)
    if day:
        topics = topics.where(on_day(F.col("created_at"), day))
    return topics.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def list_histories(steps: DataFrame, day: str | None = None, statuses: tuple[str, ...] = (), status: str | None = None) -> DataFrame:
    """``status`` joins ``statuses``; newest first."""
    wanted = sorted({*statuses, *([status] if status else [])})
    if wanted:
        steps = steps.where(F.col("status").isin(wanted))
    if day:
        steps = steps.where(on_day(F.col("started_at"), day))
    return steps.orderBy(F.desc("started_at"), F.desc("id"))


@dataclass(frozen=True)
class Page:
    items: DataFrame
    page: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)

    @property
    def first(self) -> bool:
        return self.page == 0

    @property
    def has_next(self) -> bool:
        return self.page + 1 < self.pages

    @property
    def has_previous(self) -> bool:
        return self.page > 0

    @property
    def last(self) -> bool:
        return not self.has_next


def paged(ordered: DataFrame, page: int | None = None, size: int | None = None) -> Page:
    """Page ``page`` (from 0) of ``size`` (20) rows, with the total in a second job."""
    page, size = page or 0, size or 20
    return Page(ordered.offset(page * size).limit(size), page, size, ordered.count())


def after_key(df: DataFrame, at: Column, key: Column, last_at, last_key, size: int = 20) -> DataFrame:
    """The ``size`` rows that follow (last_at, last_key) in descending order: pages at scale, without an offset."""
    return df.where((at < F.lit(last_at)) | ((at == F.lit(last_at)) & (key < F.lit(last_key)))).orderBy(at.desc(), key.desc()).limit(size)


def newest(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(k)


def last_collected(runs: DataFrame) -> DataFrame:
    """finished_at of the newest finished one among the ten newest runs; null if there is none."""
    found = newest(runs).where("finished_at IS NOT NULL").orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    return found.agg(F.max("finished_at").alias("last_collected_at"))


def latest_run_date(runs: DataFrame, as_of: str | None = None) -> DataFrame:
    """run_date of the newest run (null without runs) and, with ``as_of``, the day of that time as today."""
    found = runs.agg(F.date_format(F.max("started_at"), "yyyy-MM-dd").alias("run_date"))
    return found.withColumn("today", F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd")) if as_of else found


def get(df: DataFrame, id_: int) -> DataFrame:
    """The one row with this id, else NotFound."""
    row = df.where(F.col("id") == id_).limit(1)
    if row.isEmpty():
        raise NotFound(f"no row {id_}")
    return row


def get_by_name(df: DataFrame, name: str) -> DataFrame:
    """The one row of this name, else NotFound."""
    row = df.where(F.col("name") == name).limit(1)
    if row.isEmpty():
        raise NotFound(f"no row named {name}")
    return row


def existing(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys a stored row has; null keys exist nowhere."""
    return rows.join(stored.select(*keys), list(keys), "left_semi")


def is_stored(rows: DataFrame, stored: DataFrame, *keys: str, name: str = "is_stored") -> DataFrame:
    """Adds whether a stored row has the keys; null keys exist nowhere."""
    known = stored.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.drop(name).join(known, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def between(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both counting."""
    return rows.where(F.col(at).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def active_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where("active")


def count_status(rows: DataFrame, statuses: tuple[str, ...], start: str | None = None, end: str | None = None) -> DataFrame:
    """n, the number of rows of these statuses, of all times or of those started from ``start`` to ``end``."""
    if start and end:
        rows = between(rows, "started_at", start, end)
    return rows.where(F.col("status").isin(*statuses)).agg(F.count("*").alias("n"))


def with_run(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps with the counts of their run."""
    counts = ("fetched_count", "saved_count", "clustered_count", "summarized_count")
    return steps.join(runs.select(F.col("id").alias("pipeline_run_id"), *counts), "pipeline_run_id")


def article_rows(articles: DataFrame, publishers: DataFrame) -> DataFrame:
    """What a listing shows of an article: its fields with its publisher's name, country and leaning."""
    full = with_publisher(articles, publishers)
    return full.select("id", "headline", "url", "description", "published_at", "publisher_id", "publisher_name", "country", "political_leaning", "category", "fetched_at")


def publisher_rows(publishers: DataFrame) -> DataFrame:
    return publishers.select("id", "name", "country", "political_leaning", "rss_url", "created_at")


def history_rows(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """What a listing shows of a step: its fields with its run's counts."""
    return with_run(steps, runs).select(
        "id", "pipeline_run_id", "step", "status", "fetched_count", "saved_count", "clustered_count", "summarized_count", "processed_count",
        "success_count", "failed_count", "target_type", "target_name", "error_type", "error_message", "message", "started_at", "finished_at",
    )


def with_publisher(articles: DataFrame, publishers: DataFrame) -> DataFrame:
    p = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"), "country", "political_leaning")
    return articles.join(p, "publisher_id")


def unlinked(articles: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles that no ACTIVE topic links."""
    active = topics.where("status = 'ACTIVE'").select(F.col("id").alias("topic_id"))
    return articles.join(links.join(active, "topic_id").select(F.col("article_id").alias("id")), "id", "left_anti")


def topic_articles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links with their articles (id, headline, publisher_name, ...)."""
    return links.join(articles.withColumnRenamed("id", "article_id"), "article_id")


def topic_details(detailed: DataFrame) -> DataFrame:
    """topic_id and its articles, newest link first."""
    one = F.struct("linked_at", "article_id", "headline", "publisher_name")
    return detailed.groupBy("topic_id").agg(F.sort_array(F.collect_list(one), asc=False).alias("articles"))


def topic_tokens(links: DataFrame, articles: DataFrame) -> DataFrame:
    """For debugging: the articles of every topic with the tokens of their headlines alone."""
    columns = ("topic_id", "article_id", "publisher_name", "country", "political_leaning", "headline", "normalized_headline", "description")
    return topic_articles(links, articles).select(*columns, tokenize(F.col("headline")).alias("tokens"))


def distribution(detailed: DataFrame, column: str) -> DataFrame:
    """topic_id and the map from the column's values to their numbers of links."""
    n = detailed.groupBy("topic_id", column).agg(F.count("*").cast("int").alias("n"))
    return n.groupBy("topic_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))


def first_headlines(detailed: DataFrame) -> DataFrame:
    """topic_id, publisher_name and the headline of its first link (by link id)."""
    return detailed.groupBy("topic_id", "publisher_name").agg(F.min_by("headline", F.struct("link_id", "headline")).alias("headline"))


def topics_with_links(page: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """Topics (of a page) with leaning and country maps and first headlines; empty ones without links."""
    d = topic_articles(links.withColumnRenamed("id", "link_id").join(page.select(F.col("id").alias("topic_id")), "topic_id", "left_semi"), articles)
    heads = first_headlines(d).groupBy("topic_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("publisher_name", "headline")))).alias("headlines"))
    out = page
    for part in (distribution(d, "political_leaning"), distribution(d, "country"), heads):
        out = out.join(part.withColumnRenamed("topic_id", "id"), "id", "left")
    none = {c: F.coalesce(F.col(c), F.create_map().cast(out.schema[c].dataType)) for c in ("political_leaning_counts", "country_counts", "headlines")}
    return out.withColumns(none)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds n, the row's number from 1 in this order."""
    numbers = with_running(df, list(order), n=F.lit(1))
    return numbers.withColumn("n", F.col("n") + 1)
