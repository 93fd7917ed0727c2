"""Ingest: validation, publisher lookup, normalisation, de-duplication, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..functions.url import normalize_url
from ..sources.shared import stash
from .dedupe import dedupe


def validation_error(headline: Column, url: Column, publisher: Column) -> Column:
    """Name of the first blank required field, else null."""
    return F.when(text.is_blank(headline), "headline").when(text.is_blank(url), "url").when(text.is_blank(publisher), "publisherName")


def target_name(url: Column, guid: Column) -> Column:
    return F.coalesce(url, guid, F.lit("UNKNOWN"))


def status_of(success: Column, failed: Column) -> Column:
    """PARTIAL_FAILED, FAILED or SUCCESS."""
    return F.when((failed > 0) & (success > 0), "PARTIAL_FAILED").when(failed > 0, "FAILED").otherwise("SUCCESS")


def normalize(candidates: DataFrame, publishers: DataFrame) -> DataFrame:
    """Adds the publisher's id (null if unknown) and the normalised columns."""
    p = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisherName"))
    c = candidates.join(p, "publisherName", "left")
    nh = text.normalize_headline(text.sanitize_text(F.col("headline")))
    return c.select(
        "pos", "publisherCode", "publisherName", "publisher_id", "url", "publishedAt", "category", "rssGuid",
        text.sanitize_text(F.col("headline")).alias("clean_headline"), F.col("headline").alias("raw_headline"), nh.alias("normalized_headline"),
        normalize_url(F.col("url")).alias("normalized_url"), text.sanitize_html(F.col("description")).alias("description"),
        text.dedupe_key(F.col("publisherName"), nh, F.col("publishedAt")).alias("dedupe_key"),
    )


@dataclass
class Ingest:
    """Tables of one ingest: articles to append, the outcome of every candidate (with the id of its article), feeds,
    validation errors, totals."""

    articles: DataFrame
    outcomes: DataFrame
    feeds: DataFrame
    errors: DataFrame
    totals: DataFrame


def ingest(candidates: DataFrame, feed_status: DataFrame, publishers: DataFrame, store: DataFrame, as_of: str, max_len: int | None = 255) -> Ingest:
    """candidates (pos and the candidate columns), feed_status (publisherCode, publisherName, success, errorType,
    errorMessage) → new articles and counters.

    Rows that miss a field, have an unknown publisher or a value over ``max_len`` fail and suppress nothing.
    A failed feed counts as one failure of the total. Article ids are hashes of the dedupe key.
    """
    error = validation_error(F.col("headline"), F.col("url"), F.col("publisherName"))
    checked = stash(candidates.withColumn("missing", error))
    n = normalize(checked.where("missing IS NULL"), publishers)
    long_ = F.lit(False)
    for c in ("clean_headline", "normalized_headline", "url", "normalized_url", "rssGuid") if max_len else ():
        long_ = long_ | F.coalesce(F.length(c) > max_len, F.lit(False))
    n = stash(n.withColumn("broken", F.col("publisher_id").isNull() | long_))
    rows = n.where("NOT broken").withColumnRenamed("rssGuid", "rss_guid")
    judged = stash(dedupe(rows, store))
    now = F.lit(as_of).cast("timestamp_ntz")
    articles = judged.where("reason IS NULL").select(
        F.xxhash64("dedupe_key").alias("id"), F.col("clean_headline").alias("headline"), "normalized_headline", "url", "normalized_url", "description",
        F.col("publishedAt").alias("published_at"), "publisher_id", "category", "rss_guid", "dedupe_key", now.alias("fetched_at"),
    )
    outcomes = (
        judged.select("pos", "publisherCode", "reason", F.lit(None).cast("string").alias("failure"), F.when(F.col("reason").isNull(), F.xxhash64("dedupe_key")).alias("article_id"))
        .unionByName(n.where("broken").select("pos", "publisherCode", F.lit(None).cast("string").alias("reason"), F.lit("SAVE_FAILED").alias("failure")), allowMissingColumns=True)
        .unionByName(checked.where("missing IS NOT NULL").select("pos", "publisherCode", F.lit(None).cast("string").alias("reason"), F.lit("VALIDATION").alias("failure")), allowMissingColumns=True)
    )
    outcomes = stash(outcomes)
    errors = checked.where("missing IS NOT NULL").select(
        "pos", target_name(F.col("url"), F.col("rssGuid")).alias("target_name"), F.lit("VALIDATION_ERROR").alias("error_type"),
        F.concat(F.col("missing"), F.lit(" is missing")).alias("error_message"),
    )
    feeds = feed_counters(outcomes, feed_status)
    return Ingest(articles, outcomes, feeds, errors, total_counters(feeds, outcomes))


def with_refused(got: Ingest, refused: DataFrame, feed_status: DataFrame) -> Ingest:
    """The ingest after the store has refused some of its articles (by id): these failed to be saved."""
    ids = refused.select(F.col("id").alias("article_id"), F.lit(True).alias("refused"))
    outcomes = stash(got.outcomes.join(ids, "article_id", "left").withColumn("failure", F.when(F.col("refused"), "SAVE_FAILED").otherwise(F.col("failure"))).drop("refused"))
    feeds = feed_counters(outcomes, feed_status)
    return Ingest(got.articles.join(refused.select("id"), "id", "left_anti"), outcomes, feeds, got.errors, total_counters(feeds, outcomes))


def feed_counters(outcomes: DataFrame, feed_status: DataFrame) -> DataFrame:
    """One row per feed: fetched, saved, duplicates, failed and whether it was collected; failed feeds come first."""
    per = outcomes.groupBy("publisherCode").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("reason").isNull() & F.col("failure").isNull()).alias("saved"),
        F.count_if(F.col("reason").isNotNull()).alias("duplicates"), F.count_if(F.col("failure").isNotNull()).alias("failed"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("fetched", "saved", "duplicates", "failed")}
    return feed_status.join(per, "publisherCode", "left").withColumns(zero).orderBy("success", "publisherCode")


def total_counters(feeds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: fetched, saved, duplicates, failed (with one for each failed feed), save_failed (without), reasons."""
    total = feeds.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "saved", "duplicates")],
        F.coalesce(F.sum(F.col("failed") + F.when(F.col("success"), 0).otherwise(1)), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("failed")).otherwise(0)), F.lit(0)).alias("save_failed"),
    )
    reasons = outcomes.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    map_ = reasons.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return total.join(map_, how="cross")  # one row each


def merge_totals(batches: list[DataFrame]) -> DataFrame:
    """Sums of several batches' totals; reasons are dropped."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.agg(*[F.sum(c).alias(c) for c in ("fetched", "saved", "duplicates", "failed", "save_failed")])


def unknown_codes(candidates: DataFrame) -> DataFrame:
    """Candidates without a known feed code, which abort a load."""
    return candidates.where(F.col("publisherCode").isNull() | ~F.col("publisherCode").isin([f[0] for f in schema.FEEDS]))
