"""Orchestration: collect, save, cluster, summarise, record."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers, schema
from ..operators import lineage
from ..operators.cluster import cluster
from ..operators.generate import generate_once
from ..operators.ingest import Ingest, ingest, unknown_codes, with_refused
from ..operators.read import with_publisher
from ..operators.summarize import Summarizer, apply_summaries, prompts, summarize
from ..sources.feeds import batch_candidates, batch_feed_status, collect, read_json_batches
from ..sources.shared import stash
from ..sources.tables import Store
from .events import Event, EventBus

NOTHING = {"fetched": 0, "saved": 0, "duplicates": 0, "failed": 1, "save_failed": 0}


@dataclass
class RunResult:
    run_id: int
    status: str
    totals: dict[str, int]
    clustering: list[tuple[str, int]] = field(default_factory=list)
    summaries: int = 0


class Pipeline:
    """Runs over a store; every time is the given one, never the clock's."""

    def __init__(self, spark: SparkSession, store: Store, bus: EventBus | None = None, summarizer: Summarizer | None = None, answers: str | None = None):
        """``answers`` is a folder that keeps generated texts by prompt, so that none is asked for twice."""
        on_workers(spark)
        self.spark, self.store, self.bus, self.summarizer, self.answers = spark, store, bus or EventBus(), summarizer, answers

    def run(self, fetch: Callable, as_of: datetime, hours: int = 48, codes: list[str] | None = None) -> RunResult:
        """Live run. A stage that fails doesn't stop the next; the status depends on fetching and saving only."""
        if not 1 <= hours <= 168:
            raise ValueError("hours must be from 1 to 168")
        run_id = self._begin(as_of, "run")
        self._say(run_id, "RSS_COLLECT", "RUNNING", "RSS 피드 수집 중...", 10)
        got: Ingest | None = None
        totals = dict(NOTHING)
        try:
            candidates, status = collect(self.spark, fetch, codes)
            got, totals = self.save(run_id, stash(candidates), stash(status), as_of)
        except Exception:  # counted as one failure; later stages go on
            got = None
        self._say(run_id, "TOPIC_CLUSTERING", "RUNNING", "유사 기사 토픽 클러스터링 중...", 50)
        clustered, broken = self.cluster_all(as_of, hours)
        self._say(run_id, "TOPIC_CLUSTERING", "FAILED" if broken else "SUCCESS", "일부 카테고리 클러스터링 실패 (이후 단계 계속 진행)" if broken else "토픽 클러스터링 완료", 70)
        self._say(run_id, "AI_SUMMARY", "RUNNING", "AI 요약 생성 중...", 75)
        summaries, broken = self.summarize_pending(as_of)
        self._say(run_id, "AI_SUMMARY", "FAILED" if broken else "SUCCESS", "AI 요약 실패" if broken else "AI 요약 완료", 95)
        result = self._finish(run_id, got, totals, clustered, summaries, as_of)
        self._say(run_id, "COMPLETED", "SUCCESS", "파이프라인 실행이 완료되었습니다.", 100)
        return result

    def load_batches(self, folder: str, as_of: datetime, hours: int = 24) -> list[RunResult]:
        """Named loads of a folder's JSON files, in the order of their names: later ones see earlier rows."""
        batches = read_json_batches(self.spark, folder)
        names = [r["file_name"] for r in batches.select("file_name").collect()]
        return [self._load(n, batches.where(F.col("file_name") == n), as_of, hours) for n in names] or [self._load("EMPTY_DEMO_DATA", None, as_of, hours)]

    def _load(self, name: str, batch: DataFrame | None, as_of: datetime, hours: int) -> RunResult:
        run_id = self._begin(as_of, name)
        if batch is None:
            candidates = self.spark.createDataFrame([], schema.CANDIDATE).withColumn("pos", F.lit(0).cast("long"))
            status = self.spark.createDataFrame([], "publisherCode string, publisherName string, success boolean, errorType string, errorMessage string")
        else:
            candidates = stash(batch_candidates(batch))
            if not unknown_codes(candidates).isEmpty():
                raise ValueError(f"{name} has an article without a known feed code")
            status = stash(batch_feed_status(batch, candidates))
        got, totals = self.save(run_id, candidates, status, as_of)
        clustered, _ = self.cluster_all(as_of, hours)
        summaries, _ = self.summarize_pending(as_of)
        return self._finish(run_id, got, totals, clustered, summaries, as_of, name)

    def preview(self, fetch: Callable, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Candidates and feed status, without saving."""
        return collect(self.spark, fetch, codes)

    def save(self, run_id: int, candidates: DataFrame, status: DataFrame, as_of: datetime) -> tuple[Ingest, dict[str, int]]:
        for f in status.orderBy("publisherCode").collect():  # a row for each feed
            ok = f["success"]
            self._say(run_id, "RSS_COLLECT", "SUCCESS" if ok else "FAILED", f"{f['publisherName']} RSS 수집 {'완료' if ok else '실패'}", 10, f["publisherName"], f["errorMessage"])
        got = ingest(candidates, status, self.store.read("publisher"), self.store.read("article"), str(as_of))
        refused = self.store.append_unique("article", got.articles, "normalized_url", "dedupe_key")  # another writer may have added them meanwhile
        if not refused.isEmpty():
            got = with_refused(got, refused, status)
        totals = {k: v for k, v in got.totals.first().asDict().items() if k != "reasons"}
        text = f"기사 저장 완료 (저장 {totals['saved']}건, 중복 {totals['duplicates']}건, 실패 {totals['failed']}건)"
        self._say(run_id, "ARTICLE_SAVE", "FAILED" if totals["failed"] else "SUCCESS", text, 45)
        return got, totals

    def articles(self) -> DataFrame:
        return with_publisher(self.store.read("article"), self.store.read("publisher"))

    def cluster_all(self, as_of: datetime, hours: int) -> tuple[list[tuple[str, int]], bool]:
        done, broken = [], False
        for category in schema.CATEGORIES:
            try:
                made = cluster(self.articles(), self.store.read("topic_article"), self.store.read("topic"), str(as_of), category, hours)
                n = 0
                if made.topics is not None:
                    topics, links = stash(made.topics), stash(made.links)
                    n = topics.count()
                    self.store.append("topic", topics)
                    self.store.append("topic_article", links)
                done.append((category, n))
            except Exception:  # the category is left out
                broken = True
        return done, broken

    def summarize_pending(self, as_of: datetime) -> tuple[int, bool]:
        try:
            topics = self.store.read("topic")
            asked = prompts(topics, self.store.read("topic_article"), self.articles())
            made = stash(generate_once(asked, self.answers, self.summarizer) if self.answers else summarize(asked, self.summarizer))
            n = made.where("error IS NULL").count()
            if n:
                done = made.where("error IS NULL").select(F.col("topic_id").alias("id"))
                self.store.update_latest("topic", apply_summaries(topics.join(done, "id", "left_semi"), made, str(as_of)))
            return n, False
        except Exception:  # no summaries; the run goes on
            return 0, True

    def _begin(self, as_of: datetime, name: str) -> int:
        number = self.store.read("pipeline_run").count()
        run_id = number * (1 << 20) + zlib.crc32(f"{as_of}{name}".encode()) % (1 << 20)
        self._put_run(run_id, "RUNNING", {}, 0, 0, "파이프라인 실행 중", None, as_of, None)
        return run_id

    def _put_run(self, run_id, status, totals, clusters, summaries, message, error, started, finished) -> None:
        kinds = schema.TABLES["pipeline_run"]
        row = [(run_id, status, totals.get("fetched", 0), totals.get("saved", 0), clusters, summaries, message, error, started, finished)]
        self.store.update_latest("pipeline_run", self.spark.createDataFrame(row, kinds))

    def _finish(self, run_id: int, got: Ingest | None, totals: dict[str, int], clustered: list[tuple[str, int]], summaries: int, as_of: datetime, batch: str | None = None) -> RunResult:
        status = lineage.status_from_counts(totals["saved"], totals["failed"])
        bad = status != "SUCCESS"
        self._put_run(run_id, status, totals, sum(n for _, n in clustered), summaries, "일부 단계 실패" if bad else "파이프라인 정상 완료", "실패한 단계 이력을 확인하세요." if bad else None, as_of, as_of)
        rows = lineage.step_rows(self.spark, run_id, got.feeds if got else None, totals, got.errors if got else None, clustered, summaries, as_of, as_of, batch)
        self.store.append("pipeline_step_history", rows)
        return RunResult(run_id, status, totals, clustered, summaries)

    def _say(self, run_id: int, step: str, status: str, message: str, progress: int, target: str | None = None, error: str | None = None) -> None:
        self.bus.publish(Event(run_id, step, status, message, progress, target, error))
