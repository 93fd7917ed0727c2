import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newslens.operators import read, summarize
from newslens.operators.lineage import status_from_counts
from newslens.plans.events import Event, EventBus
from newslens.plans.pipeline import Pipeline
from newslens.sources.feeds import classify, fixture_fetcher, select_feeds
from newslens.sources.tables import Conflict, NotFound, Store, seed

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><lastBuildDate>Wed, 08 Apr 2026 10:00:00 GMT</lastBuildDate>
<item><title>Iran talks open</title><link>https://h.kr/1</link><description><![CDATA[<img src=x>]]></description><guid>123</guid></item>
<item><title>No link</title><link> </link></item></channel></rss>"""


def _article(code, publisher, i, **more):
    base = {"publisherCode": code, "publisherName": publisher, "country": "US", "politicalLeaning": "CONSERVATIVE", "category": "WORLD", "headline": f"Story {i} of Iran talks",
            "url": f"https://n.com/{i}", "description": None, "rssGuid": f"g{i}", "publishedAt": "2026-04-08T10:00:00", "unknown": 1}
    return base | more


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    seed(s, "2026-04-01 00:00:00")
    seed(s, "2026-04-02 00:00:00")
    return s


def test_batches_and_live_run(spark, store, tmp_path):
    assert (store.read("publisher").count(), store.read("publisher_feed").count()) == (4, 4)
    folder = tmp_path / "batches"
    folder.mkdir()
    errors = [{"feedSourceCode": "NYT_WORLD", "errorType": " ", "errorMessage": None}, {"feedSourceCode": "NOPE"}]
    rows = [_article("FOX_WORLD", "Fox News", i) for i in range(3)] + [_article("FOX_WORLD", "Fox News", 9, headline=" "), _article("FOX_WORLD", "Nobody", 10)]
    (folder / "2026-04-08.json").write_text(json.dumps({"articles": rows, "feedErrors": errors}))
    (folder / "2026-04-07.json").write_text("{bad")
    (folder / "odd.json").write_text(json.dumps([_article("FOX_WORLD", "Fox News", 5, country="XX")]))
    heard = []
    p = Pipeline(spark, store)
    p.bus.register(heard.append)
    (got,) = p.load_batches(str(folder), datetime(2026, 4, 8, 12))
    assert got.totals == {"fetched": 5, "saved": 3, "duplicates": 0, "failed": 3, "save_failed": 2} and got.status == "PARTIAL_FAILED"
    steps = store.read("pipeline_step_history")
    assert {(r["step"], r["status"], r["n"]) for r in steps.groupBy("step", "status").agg(F.count("*").alias("n")).collect()} == {
        ("RSS_COLLECT", "SUCCESS", 1), ("RSS_COLLECT", "FAILED", 1), ("ARTICLE_SAVE", "PARTIAL_FAILED", 1), ("ARTICLE_SAVE", "FAILED", 1),
        ("TOPIC_CLUSTERING", "SUCCESS", 1), ("AI_SUMMARY", "SUCCESS", 1), ("COMPLETED", "SUCCESS", 1)}
    (again,) = p.load_batches(str(folder), datetime(2026, 4, 8, 13))
    assert (again.totals["saved"], again.totals["duplicates"], again.status) == (0, 3, "FAILED")

    feeds = tmp_path / "feeds"
    feeds.mkdir()
    (feeds / "HANI_WORLD.xml").write_text(FEED)
    run = p.run(fixture_fetcher(str(feeds)), datetime(2026, 4, 8, 14))
    assert (run.totals["fetched"], run.totals["saved"], run.totals["failed"], run.status) == (1, 1, 3, "PARTIAL_FAILED")
    assert run.clustering == [("WORLD", 1)] and run.summaries == 1
    new = store.read("article").where("rss_guid = '123'").first()
    assert new["published_at"] == datetime(2026, 4, 8, 10) and new["description"] is None
    topic = store.read("topic").first()
    assert topic["ai_model"] == "stub" and topic["status"] == "ACTIVE"
    assert store.read("pipeline_run").count() == 3 and store.read("pipeline_run").where("status = 'RUNNING'").count() == 0
    assert [e.progress for e in heard][-4:] == [70, 75, 95, 100] and heard[-1].status == "SUCCESS"
    store.check_unique("article", "normalized_url")
    store.check_unique("article", "dedupe_key")
    with pytest.raises(Conflict):
        store.delete("publisher", new["publisher_id"])
    with pytest.raises(NotFound):
        store.delete("publisher", 5)
    full = read.topics_with_links(store.read("topic"), store.read("topic_article"), p.articles()).first()
    assert sum(full["political_leaning_counts"].values()) == 4 and set(full["headlines"]) == {"Fox News", "Hankyoreh"}


def test_empty_folder(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text("nonsense")
    (got,) = Pipeline(spark, s).load_batches(str(tmp_path / "b"), datetime(2026, 1, 1))
    assert got.status == "SUCCESS" and s.read("pipeline_step_history").where("target_name = 'EMPTY_DEMO_DATA'").count() == 2


def test_small_parts(spark):
    assert [status_from_counts(*x) for x in ((5, 0), (5, 1), (0, 1), (0, 0))] == ["SUCCESS", "PARTIAL_FAILED", "FAILED", "SUCCESS"]
    assert [r["publisherCode"] for r in select_feeds(spark, ["HANI_WORLD", "X", "FOX_WORLD", "HANI_WORLD"]).collect()] == ["HANI_WORLD", "FOX_WORLD", "HANI_WORLD"]
    e = RuntimeError("feed failed")
    e.__cause__ = TimeoutError("slow")
    assert classify(e) == "RSS_TIMEOUT" and classify(RuntimeError("https://x/y.xml")) == "RSS_PARSE_ERROR" and classify(RuntimeError("no")) == "RSS_FEED_ERROR"
    bus, seen = EventBus(), []
    bus.register(lambda e: 1 / 0)
    stop = bus.register(seen.append)
    for _ in range(2):
        bus.publish(Event(1, "COMPLETED", "SUCCESS", "", 100))
    stop()
    bus.publish(Event(1, "COMPLETED", "SUCCESS", "", 100))
    assert len(seen) == 2
    with pytest.raises(ValueError):
        read.since(F.col("x"), "2026-01-01", 169)
    assert summarize.Fallback(summarize.Stub()).generate("x") == summarize.Stub().generate("y")


def test_day_is_closed_at_both_ends(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-02 00:00:00' AS t")
    assert df.where(read.on_day(F.col("t"), "2026-01-01")).count() == df.where(read.on_day(F.col("t"), "2026-01-02")).count() == 1
    assert df.where(read.on_day(F.col("t"), "2026-01-01", half_open=True)).count() == 0


def test_anti_join_plan(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(7, 1)], "topic_id long, article_id long")
    topics = spark.createDataFrame([(7, "ACTIVE")], "id long, status string")
    got = read.unlinked(a, links, topics)
    assert [r["id"] for r in got.collect()] == [2] and "LeftAnti" in got._jdf.queryExecution().executedPlan().toString()
