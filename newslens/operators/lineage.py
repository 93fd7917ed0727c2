"""Lineage: one row for each step of a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

# Messages of the steps.
MESSAGES = {
    "feed_ok": "RSS 피드 수집 완료", "feed_failed": "RSS 피드 수집 실패", "all_ok": "RSS 수집/저장 완료", "all_failed": "RSS 수집/저장 실패",
    "all_error": "RSS 수집/저장 단계가 실패했습니다.", "saved": "기사 저장 완료 (저장 {saved}건)", "saved_partly": "기사 저장 부분 실패 (저장 {saved}건, 실패 {failed}건)",
    "save_error": "{failed}건의 기사 저장에 실패했습니다.", "invalid": "필수 필드 누락으로 기사 저장 건너뜀", "clustered": "토픽 클러스터링 완료",
    "summarized": "AI 요약 생성 완료", "completed": "파이프라인 실행 완료", "batch_ok": "RSS 수집 완료", "batch_error": "데모 JSON 수집/저장 단계가 실패했습니다.",
}


def status_from_counts(success: int, failed: int) -> str:
    return "PARTIAL_FAILED" if failed > 0 and success > 0 else "FAILED" if failed > 0 else "SUCCESS"


def step_rows(
    spark: SparkSession, run_id: int, feeds: DataFrame | None, totals: dict[str, int], errors: DataFrame | None, clustering: list[tuple[str, int]],
    summaries: int, started_at: datetime, finished_at: datetime, batch: str | None = None,
) -> DataFrame:
    """Rows of pipeline_step_history: collection per feed, saving, one per validation error, clustering per
    category, summaries, completion. A live run without feeds has one collection row and no saving row; a
    ``batch`` (a named load) always has a saving row, and a row for all categories if none was clustered."""
    at, end = F.lit(started_at).cast("timestamp_ntz"), F.lit(finished_at).cast("timestamp_ntz")
    kinds = schema.TABLES["pipeline_step_history"]
    plain: list[tuple] = []

    def step(name, status, kind, target, processed, success, failed, message, error_type=None, error=None, begin=finished_at):
        plain.append((name, status, kind, target, processed, success, failed, error_type, error, message, begin, finished_at))

    saved, save_failed = totals.get("saved", 0), totals.get("save_failed", 0)
    n_feeds = feeds.count() if feeds is not None else 0
    if not n_feeds:
        failed, fetched = totals.get("failed", 0), totals.get("fetched", 0)
        bad = failed > 0
        kind, target = ("DEMO_JSON", batch) if batch else ("PIPELINE", "ALL_FEEDS")
        step("RSS_COLLECT", status_from_counts(fetched, failed), kind, target, fetched, fetched, failed,
             MESSAGES["all_failed"] if bad else MESSAGES["batch_ok" if batch else "all_ok"],
             ("DEMO_RSS_COLLECT_FAILED" if batch else "RSS_COLLECT_FAILED") if bad else None, MESSAGES["batch_error" if batch else "all_error"] if bad else None, started_at)
        if errors is not None and batch:
            save_failed = errors.count()
    if n_feeds or batch:
        names = {"saved": saved, "failed": save_failed}
        step("ARTICLE_SAVE", status_from_counts(saved, save_failed), "ARTICLE", "NORMALIZED_ARTICLES", saved + save_failed, saved, save_failed,
             MESSAGES["saved_partly" if save_failed else "saved"].format(**names), "ARTICLE_SAVE_PARTIAL_FAILED" if save_failed else None,
             MESSAGES["save_error"].format(**names) if save_failed else None)
    for category, n in clustering or ([("ALL_CATEGORIES", 0)] if batch else []):
        step("TOPIC_CLUSTERING", "SUCCESS", "ARTICLE_CATEGORY", category, n, n, 0, MESSAGES["clustered"])
    step("AI_SUMMARY", "SUCCESS", "TOPIC", "ACTIVE_TOPICS", summaries, summaries, 0, MESSAGES["summarized"])
    step("COMPLETED", "SUCCESS", "PIPELINE", batch or "FULL_PIPELINE", 0, 0, 0, MESSAGES["completed"])
    names = [f.name for f in kinds.fields[2:]]
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields[2:])
    rows = spark.createDataFrame(plain, spec)
    if n_feeds:
        ok = F.col("success")
        rows = rows.unionByName(feeds.select(
            F.lit("RSS_COLLECT").alias("step"), F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), F.lit("PUBLISHER_FEED").alias("target_type"),
            F.col("publisherName").alias("target_name"), F.col("fetched").cast("int").alias("processed_count"),
            F.when(ok, F.col("fetched")).otherwise(0).cast("int").alias("success_count"), F.when(ok, 0).otherwise(1).alias("failed_count"),
            F.when(ok, None).otherwise(F.col("errorType")).alias("error_type"), F.col("errorMessage").alias("error_message"),
            F.when(ok, MESSAGES["feed_ok"]).otherwise(MESSAGES["feed_failed"]).alias("message"), at.alias("started_at"), end.alias("finished_at"),
        ))
    if errors is not None and (n_feeds or batch):
        rows = rows.unionByName(errors.select(
            F.lit("ARTICLE_SAVE").alias("step"), F.lit("FAILED").alias("status"), F.lit("ARTICLE").alias("target_type"), "target_name",
            F.lit(0).alias("processed_count"), F.lit(0).alias("success_count"), F.lit(1).alias("failed_count"), "error_type", "error_message",
            F.lit(MESSAGES["invalid"]).alias("message"), end.alias("started_at"), end.alias("finished_at"),
        ))
    return rows.select(F.xxhash64(F.lit(run_id), *names).alias("id"), F.lit(run_id).cast("long").alias("pipeline_run_id"), *names)
