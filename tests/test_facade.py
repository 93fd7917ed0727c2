"""The facade over one store, from ingest to dashboard."""

from datetime import datetime

import pytest

from newslens.errors import Conflict, NotFound
from newslens.operators import dashboard
from newslens.plans.facade import NewsLens
from newslens.sources.feed_source import FeedSource

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><lastBuildDate>Wed, 08 Apr 2026 10:00:00 GMT</lastBuildDate>{}</channel></rss>"""
ITEM = "<item><title>{}</title><link>https://{}/{}</link><guid>{}</guid></item>"


@pytest.fixture(scope="module")
def lens(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    for code, host in (("FOX_WORLD", "fox"), ("HANI_WORLD", "hani")):
        items = [("Iran talks open in Oman", 1), ("100% of something else", 2)]
        (folder / f"{code}.xml").write_text(RSS.format("".join(ITEM.format(t, host, i, f"{host}{i}") for t, i in items)))
    lens = NewsLens(spark, str(tmp_path_factory.mktemp("store")), "2026-04-01 00:00:00")
    lens.source = FeedSource(folder=str(folder))
    lens.run = lens.pipeline.run(lens.source, datetime(2026, 4, 8, 12))
    return lens


def test_run_and_listings(lens):
    assert (lens.run.totals["saved"], lens.run.totals["failed"], lens.run.status) == (4, 2, "PARTIAL_FAILED")
    page = lens.articles.list(headline="% OF", size=1)
    assert (page.total, page.pages, [r["headline"] for r in page.items.collect()]) == (2, 2, ["100% of something else"])
    one = page.items.first()
    got = lens.articles.get(one["id"]).first()
    assert got["publisher_name"] in ("Fox News", "Hankyoreh") and got["url"] == one["url"]
    with pytest.raises(NotFound):
        lens.articles.get(5)
    assert lens.articles.list(day="2026-04-08").total == 4 and lens.articles.list(day="2026-04-10").total == 0


def test_topics(lens):
    assert lens.run.clustering[0][1] >= 1
    page = lens.topics.list(status="ACTIVE")
    topic = next(r for r in page.items.collect() if "Iran" in r["title"])
    assert topic["political_leaning_counts"] == {"CONSERVATIVE": 1, "PROGRESSIVE": 1} and topic["ai_model"] == "stub"
    detail = lens.topics.get(topic["id"]).first()
    assert {a["publisher_name"] for a in detail["articles"]} == {"Fox News", "Hankyoreh"}
    assert "iran" in lens.topics.tokens(topic["id"]).first()["tokens"]
    assert lens.topics.cluster(datetime(2026, 4, 8, 13)) == [("WORLD", 0)] and lens.topics.summarize(datetime(2026, 4, 8, 13)) == 0
    assert lens.topics.candidates(datetime(2026, 4, 8, 13)).count() in (0, 2)
    with pytest.raises(NotFound):
        lens.topics.get(1)


def test_publishers(lens):
    rows = lens.publishers.list().collect()
    assert len(rows) == 4 and lens.publishers.get(rows[0]["id"]).first()["name"] == rows[0]["name"]
    with pytest.raises(Conflict):
        lens.publishers.delete(rows[0]["id"])
    with pytest.raises(NotFound):
        lens.publishers.delete(1)


def test_ingest_lineage_and_dashboard(lens, tmp_path):
    candidates, status = lens.ingest.preview(lens.source, ["HANI_WORLD"])
    assert candidates.count() == 2 and status.first()["success"]
    assert lens.ingest.save(lens.source, datetime(2026, 4, 8, 14), ["HANI_WORLD"])["duplicates"] == 2
    page = lens.lineage.histories(day="2026-04-08", statuses=("FAILED",), size=50)
    assert page.total == 2 and {r["error_type"] is not None for r in page.items.collect()} == {True}
    assert lens.pipeline.latest_run_date("2026-04-09 01:00:00").first().asDict() == {"run_date": "2026-04-08", "today": "2026-04-09"}
    s, steps, runs = lens.store, lens.store.read("pipeline_step_history"), lens.store.read("pipeline_run")
    assert lens.dashboard.summary("2026-04-08").collect() == dashboard.full_summary(s.read("article"), s.read("topic"), steps, runs, "2026-04-08").collect()
    charts = {(r["chart"], r["name"]): r["n"] for r in lens.dashboard.charts("2026-04-08").collect()}
    assert charts["articlesByPublisher", "Fox News"] == 2 and charts["topicsByCountry", "KR"] >= 1
    out = lens.pipeline.export_json(lens.source, str(tmp_path / "o"), "2026-04-08")
    assert out["total"] == 4 and [f["success"] for f in out["feeds"]] == [True, False, False, True]


def test_events_of_the_run_in_order(lens):
    seen = [r["progress"] for r in lens.events.read().where(f"run_id = {lens.run.run_id}").orderBy("seq").collect()]
    assert seen == sorted(seen) and seen[0] == 10 and seen[-1] == 100 and {45, 50, 70, 75, 95} <= set(seen)
