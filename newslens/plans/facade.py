"""One object for what a client asks: ``NewsLens(spark, path)`` with articles, publishers, topics, ingest, pipeline,
lineage, dashboard and events. Listings are pages; single rows are DataFrames of one row, or NotFound."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, read, rollup
from ..operators.cluster import corpus_text
from ..operators.summarize import Summarizer
from ..sources.counted import CountedStore
from ..sources.feed_source import FeedSource
from ..sources.feeds import export_snapshot
from ..sources.tables import seed
from .event_table import EventTable
from .events import EventBus
from .pipeline import Pipeline, RunResult


class _Part:
    def __init__(self, lens: NewsLens):
        self._lens, self._store, self._pipeline = lens, lens.store, lens.runs


class Articles(_Part):
    def list(self, headline: str | None = None, day: str | None = None, page: int | None = None, size: int | None = None) -> read.Page:
        """Newest first, with their publishers; headlines are looked up by the store's grams."""
        rows = self._store.search(headline) if headline else self._store.read("article")
        found = read.paged(read.list_articles(rows, None, day), page, size)
        rows = read.article_rows(found.items, self._store.read("publisher")).orderBy(F.desc_nulls_last("published_at"), F.desc("id"))
        return replace(found, items=rows)

    def get(self, id_: int) -> DataFrame:
        return read.article_rows(read.get(self._store.read("article"), id_), self._store.read("publisher"))


class Publishers(_Part):
    def list(self) -> DataFrame:
        return read.publisher_rows(self._store.read("publisher")).orderBy("id")

    def get(self, id_: int) -> DataFrame:
        return read.publisher_rows(read.get(self._store.read("publisher"), id_))

    def delete(self, id_: int) -> None:
        """NotFound without it, Conflict while articles or feeds refer to it."""
        self._store.delete("publisher", id_)


class Topics(_Part):
    def list(self, status: str | None = None, day: str | None = None, page: int | None = None, size: int | None = None) -> read.Page:
        """Newest first, with leaning and country counts and first headlines."""
        found = read.paged(read.list_topics(self._store.read("topic"), status, day), page, size)
        full = read.topics_with_links(found.items, self._store.read("topic_article"), self._pipeline.articles())
        return replace(found, items=full.orderBy(F.desc_nulls_last("created_at"), F.desc("id")))

    def get(self, id_: int) -> DataFrame:
        """The topic with its articles, newest link first."""
        one, links = read.get(self._store.read("topic"), id_), self._store.read("topic_article")
        detail = read.topic_details(read.topic_articles(links.where(F.col("topic_id") == id_), self._pipeline.articles()))
        return one.join(detail.withColumnRenamed("topic_id", "id"), "id", "left")

    def tokens(self, id_: int) -> DataFrame:
        """For debugging: the topic's articles with their headlines' tokens."""
        return read.topic_tokens(self._store.read("topic_article").where(F.col("topic_id") == id_), self._pipeline.articles())

    def cluster(self, as_of: datetime, hours: int = 48) -> list[tuple[str, int]]:
        return self._pipeline.cluster_all(as_of, hours)[0]

    def summarize(self, as_of: datetime) -> int:
        return self._pipeline.summarize_pending(as_of)[0]

    def candidates(self, as_of: datetime, hours: int = 48) -> DataFrame:
        """The texts of the articles in the window that no active topic links."""
        window = self._pipeline.articles().where(read.since(F.col("fetched_at"), str(as_of), hours))
        return corpus_text(read.unlinked(window, self._store.read("topic_article"), self._store.read("topic"))).select("id", "corpus_text")


class IngestPart(_Part):
    def preview(self, source: FeedSource | Callable, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Candidates and feed status, without saving."""
        return self._pipeline.preview(source, codes)

    def save(self, source: FeedSource | Callable, as_of: datetime, codes: list[str] | None = None, run_id: int = 0) -> dict[str, int]:
        """Collects and saves, without a run of its own; the totals."""
        candidates, status = self._pipeline.preview(source, codes)
        return self._pipeline.save(run_id, candidates, status, as_of)[1]


class Runs(_Part):
    def run(self, source: FeedSource | Callable, as_of: datetime, hours: int = 48, codes: list[str] | None = None) -> RunResult:
        return self._pipeline.run(source, as_of, hours, codes)

    def load_batches(self, folder: str, as_of: datetime, hours: int = 24) -> list[RunResult]:
        return self._pipeline.load_batches(folder, as_of, hours)

    def export_json(self, source: FeedSource | Callable, folder: str, day: str, codes: list[str] | None = None) -> dict:
        return export_snapshot(self._lens.spark, source, folder, day, codes)

    def latest_run_date(self, as_of: str | None = None) -> DataFrame:
        return read.latest_run_date(self._store.read("pipeline_run"), as_of)


class Lineage(_Part):
    def histories(self, day: str | None = None, statuses: tuple[str, ...] = (), status: str | None = None, page: int | None = None, size: int | None = None) -> read.Page:
        """Steps with their run's counts, newest first."""
        found = read.paged(read.list_histories(self._store.read("pipeline_step_history"), day, statuses, status), page, size)
        return replace(found, items=read.history_rows(found.items, self._store.read("pipeline_run")).orderBy(F.desc("started_at"), F.desc("id")))


class Dashboard(_Part):
    def summary(self, day: str) -> DataFrame:
        """The day's figures from the kept counts, and the ten newest steps."""
        steps, runs = self._store.read("pipeline_step_history"), self._store.read("pipeline_run")
        return dashboard.with_recent(rollup.summary(self._store.counts(), runs, day), steps, runs)

    def charts(self, day: str) -> DataFrame:
        s = self._store
        return dashboard.charts(self._pipeline.articles(), s.read("topic_article"), s.read("topic"), self._pipeline.articles(), s.read("pipeline_step_history"), day)


class NewsLens:
    """A store under ``path`` and all that is asked of it; ``seed_at`` fills the publishers and feeds that it lacks."""

    def __init__(self, spark: SparkSession, path: str, seed_at: str | None = None, summarizer: Summarizer | None = None):
        self.spark, self.store, self.bus = spark, CountedStore(spark, path), EventBus()
        if seed_at:
            seed(self.store, seed_at)
        self.runs = Pipeline(spark, self.store, self.bus, summarizer, f"{self.store.path}/answers" if summarizer else None)
        self.events = EventTable(spark, f"{self.store.path}/pipeline_event")
        self.events.listen(self.bus)
        self.articles, self.publishers, self.topics, self.ingest = Articles(self), Publishers(self), Topics(self), IngestPart(self)
        self.pipeline, self.lineage, self.dashboard = Runs(self), Lineage(self), Dashboard(self)
