"""Two writers of one store: parts, unique rows, updates that write only their rows."""

import json
import threading
from datetime import datetime

from pyspark.sql import functions as F

from newslens.plans.pipeline import Pipeline
from newslens.sources import tables
from newslens.sources.tables import Store, seed


def _rows(spark, store, ids, **more):
    kinds = store.read("article").schema
    base = {"headline": "h", "normalized_headline": "h", "url": "u", "description": None, "published_at": None, "publisher_id": 1, "category": "WORLD", "rss_guid": None, "fetched_at": datetime(2026, 4, 8)}
    full = [base | {"id": i, "normalized_url": f"https://x/{i % 100}", "dedupe_key": f"k{i}"} | more for i in ids]
    return spark.createDataFrame([tuple(r[n] for n in kinds.names) for r in full], kinds)


def test_two_writers_keep_each_other_s_rows(spark, tmp_path):
    s, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    s.append("article", _rows(spark, s, [1]))
    n = other._claim(f"{tmp_path}/article/v0", "p", 1)  # a writer that has its number and hasn't written yet
    s.append("article", _rows(spark, s, [2]))
    other._write("article", 0, n, _rows(spark, s, [3]))
    assert {r["id"] for r in s.read("article").collect()} == {1, 2, 3}


def test_unique_rows_of_threads(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("article", _rows(spark, s, [99]))
    left: list = []

    def write(first):
        refused = Store(spark, str(tmp_path)).append_unique("article", _rows(spark, s, range(first, first + 60)), "normalized_url", "dedupe_key")
        left.append({r["id"] for r in refused.collect()})

    threads = [threading.Thread(target=write, args=(f,)) for f in (100, 140, 240)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    stored = s.read("article").select("id", "normalized_url", "dedupe_key").collect()
    assert len({r["normalized_url"] for r in stored}) == len({r["dedupe_key"] for r in stored}) == len(stored) == 100
    assert len(left) == 3 and sum(map(len, left)) == 1 + 180 - 100
    assert not (tmp_path / "article" / "publishing").exists()


def test_a_lost_writer_s_lock_is_removed(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    monkeypatch.setattr(tables, "LOCK_SECONDS", 0.0)
    (tmp_path / "article").mkdir()
    (tmp_path / "article" / "publishing").touch()
    assert s.append_unique("article", _rows(spark, s, [1, 2, 101]), "normalized_url").select("id").collect()[0]["id"] == 101
    assert s.append_unique("article", _rows(spark, s, [3]), "normalized_url", "rss_guid").isEmpty()  # nulls equal nothing


class _Stale(Store):
    """Reads the articles as they were before the other writer published."""

    judging = True

    def read(self, name):
        rows = super().read(name)
        if name == "article" and self.judging:
            self.judging = False
            return rows.limit(0)
        return rows


def test_equal_rows_of_two_runs_are_one_row_and_one_failure(spark, tmp_path):
    seed(Store(spark, str(tmp_path / "s")), "2026-04-01 00:00:00")
    folder = tmp_path / "b"
    folder.mkdir()
    row = {"publisherCode": "FOX_WORLD", "publisherName": "Fox News", "country": "US", "politicalLeaning": "CONSERVATIVE", "category": "WORLD", "description": None, "publishedAt": "2026-04-08T10:00:00"}
    (folder / "2026-04-08.json").write_text(json.dumps([row | {"headline": f"Story {i}", "url": f"https://n.com/{i}", "rssGuid": f"g{i}"} for i in range(2)]))
    (first,) = Pipeline(spark, Store(spark, str(tmp_path / "s"))).load_batches(str(folder), datetime(2026, 4, 8, 12))
    (folder / "2026-04-08.json").write_text(json.dumps([row | {"headline": f"Story {i}", "url": f"https://n.com/{i}", "rssGuid": f"g{i}"} for i in range(1, 3)]))
    stale = _Stale(spark, str(tmp_path / "s"))
    (second,) = Pipeline(spark, stale).load_batches(str(folder), datetime(2026, 4, 8, 13))
    assert (first.totals["saved"], first.totals["failed"]) == (2, 0)
    assert (second.totals["fetched"], second.totals["saved"], second.totals["duplicates"], second.totals["failed"], second.status) == (2, 1, 0, 1, "PARTIAL_FAILED")
    assert stale.read("article").count() == stale.read("article").select("normalized_url").distinct().count() == 3
    step = stale.read("pipeline_step_history").where("step = 'ARTICLE_SAVE'").orderBy("started_at", F.desc("id")).collect()[-1]
    assert (step["success_count"], step["failed_count"]) == (1, 1)


def test_a_topic_s_update_writes_its_row_only(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    kinds = s.read("topic").schema
    topic = lambda i, text: (i, f"t{i}", None, text, None, None, "WORLD", "ACTIVE", None, datetime(2026, 4, 8))
    s.append("topic", spark.createDataFrame([topic(i, None) for i in range(50)], kinds))
    s.update_latest("topic", spark.createDataFrame([topic(7, "made")], kinds))
    assert s.read("topic").count() == 50 and [r["id"] for r in s.read("topic").where("ai_summary = 'made'").collect()] == [7]
    assert spark.read.parquet(f"{tmp_path}/topic/v0/p1").count() == 1
    plan = s.read("topic")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and 1 < plan.count("Scan parquet") <= tables.BUCKETS
    s.delete("topic", 7)
    assert s.read("topic").count() == 49
