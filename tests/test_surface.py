"""Atom feeds, export, debugging view, probes, error codes, the store's parts, micro-batches, numbering."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import newslens
from newslens import errors
from newslens.operators import read, summarize
from newslens.operators.graph import connected_components
from newslens.operators.numbering import with_running
from newslens.plans.events import Event, EventBus
from newslens.plans.pipeline import Pipeline
from newslens.sources.feeds import export_snapshot, feed_fetcher, read_xml_feed
from newslens.sources.shared import stash
from newslens.sources.tables import Store, seed
from newslens.streaming.microbatch import ingest_stream

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><updated>2026-04-08T09:00:00Z</updated>
<entry><title>One &amp; all</title><link rel="self" href="https://n.org/self"/><link rel="alternate" href="https://n.org/1"/><id>tag:1</id><published>2026-04-08T10:00:00Z</published><summary>short</summary></entry>
<entry><title type="html">Two</title><link href="https://n.org/2"/><id>tag:2</id><content type="html">body</content></entry>
<entry><title>No link</title><id>tag:3</id></entry></feed>"""
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><title>Talks</title><link>https://h.kr/1</link><guid>9</guid></item></channel></rss>"""


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    got = read_xml_feed(spark, str(tmp_path / "a.xml")).orderBy("item_pos").collect()
    assert [(r["headline"], r["url"], r["rssGuid"], r["description"], r["publishedAt"]) for r in got] == [
        ("One & all", "https://n.org/1", "tag:1", "short", datetime(2026, 4, 8, 10)), ("Two", "https://n.org/2", "tag:2", "body", datetime(2026, 4, 8, 9))]


def test_export(spark, tmp_path):
    (tmp_path / "HANI_WORLD.xml").write_text(RSS)
    got = export_snapshot(spark, feed_fetcher(str(tmp_path), True), str(tmp_path / "out"), "2026-04-08", ["HANI_WORLD", "FOX_WORLD"])
    assert (got["date"], got["total"], [(f["feedSourceCode"], f["success"], f["count"]) for f in got["feeds"]]) == ("2026-04-08", 1, [("HANI_WORLD", True, 1), ("FOX_WORLD", False, 0)])
    assert got["feeds"][1]["errorMessage"] and [r["headline"] for r in json.loads((tmp_path / "out" / "2026-04-08.json").read_text())] == ["Talks"]


def test_sql_functions(spark):
    newslens.register(spark)
    row = spark.sql("SELECT tokenize('Trump wins US Election') AS t, normalize_url('http://A.com/x/?utm_source=1') AS u, tokenize(null) AS n").first()
    assert (row["t"], row["u"], row["n"]) == (["donald_trump", "win", "united_states", "election"], "https://a.com/x", [])


def test_headline_tokens(spark):
    a = spark.createDataFrame([(1, "Strikes on Iran", "strikes on iran", "long text", "P", "US", "PROGRESSIVE")], "id long, headline string, normalized_headline string, description string, publisher_name string, country string, political_leaning string")
    got = read.topic_tokens(spark.createDataFrame([(7, 1)], "topic_id long, article_id long"), a).first()
    assert (got["topic_id"], got["tokens"]) == (7, ["strik", "on", "iran"])


def test_probes_and_lookups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "id long, name string")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "id long, name string")
    assert [r["id"] for r in read.existing(rows, stored, "id", "name").collect()] == [1]
    assert {(r["id"], r["is_stored"]) for r in read.is_stored(rows, stored, "id", "name").collect()} == {(1, True), (2, False), (None, False)}
    assert read.get_by_name(rows.where("id = 2"), "b").first()["id"] == 2
    with pytest.raises(errors.NotFound):
        read.get_by_name(rows, "nobody")
    day = spark.sql("SELECT timestamp_ntz'2026-01-02 10:00:00' AS fetched_at, timestamp_ntz'2026-01-02 10:00:00' AS started_at, 'FAILED' AS status, true AS active")
    assert read.between(day, "fetched_at", "2026-01-02", "2026-01-03").count() == read.active_feeds(day).count() == 1
    assert read.count_status(day, ("FAILED",)).first()["n"] == 1 and read.count_status(day, ("FAILED",), "2026-02-01", "2026-02-02").first()["n"] == 0
    assert read.latest_run_date(day, "2026-01-05 01:00:00").first().asDict() == {"run_date": "2026-01-02", "today": "2026-01-05"}


def test_pages(spark):
    rows = spark.range(45).orderBy("id")
    p = read.paged(rows, 2)
    assert ([r["id"] for r in p.items.collect()], p.total, p.pages, p.first, p.last, p.has_next, p.has_previous) == (list(range(40, 45)), 45, 3, False, True, False, True)
    assert read.paged(spark.range(0)).pages == 0


def test_error_codes():
    codes = {errors.NotFound("x"): 404, errors.Unauthorized("x"): 401, errors.Conflict("x"): 409, errors.FeedFailure("x"): 502, errors.GeneratorFailure("got 429"): 429,
             errors.GeneratorFailure("x"): 502, errors.NotReady("x"): 422, ValueError("x"): 400, KeyError("x"): 500}
    assert all(errors.status_code(e) == n for e, n in codes.items())


def test_listeners_time_out(spark):
    now, heard, greeted = [0.0], [], []
    bus = EventBus(clock=lambda: now[0])
    bus.register(heard.append, seconds=120, connected=lambda: greeted.append("connected"))
    for at in (1.0, 119.0, 120.0, 121.0):
        now[0] = at
        bus.publish(Event(1, "COMPLETED", "SUCCESS", "", 100))
    assert len(heard) == 2 and greeted == ["connected"]


def test_prompt_counts_utf16_units(spark):
    texts = ["a" * 120, "a" * 121, "a" * 119 + "😀", "a" * 118 + "😀b", "가" * 121, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["y"] for r in df.select("i", summarize.shortened(F.col("t")).alias("y")).orderBy("i").collect()]
    assert got == ["a" * 120, "a" * 120 + "…", "a" * 119 + "?…", "a" * 118 + "😀…", "가" * 120 + "…", None]


def test_store_parts(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda i, status: spark.createDataFrame([(i, status, 0, 0, 0, 0, None, None, datetime(2026, 1, 1), None)], s.read("pipeline_run").schema)
    for status in ("RUNNING", "SUCCESS"):
        s.update_latest("pipeline_run", row(1, status))
    s.append("pipeline_run", row(2, "RUNNING"))
    assert {(r["id"], r["status"]) for r in s.read("pipeline_run").collect()} == {(1, "SUCCESS"), (2, "RUNNING")}
    (tmp_path / "pipeline_run" / "v0" / "p1" / "_SUCCESS").unlink()  # an append that broke off doesn't count
    assert {(r["id"], r["status"]) for r in s.read("pipeline_run").collect()} == {(1, "RUNNING"), (2, "RUNNING")}
    for i in range(4):
        s.replace("pipeline_run", row(i, "FAILED"))
    assert [r["id"] for r in s.read("pipeline_run").collect()] == [3] and len([p for p in (tmp_path / "pipeline_run").iterdir() if p.name.startswith("v")]) == 2


def test_micro_batches_in_order_of_arrival(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    seed(s, "2026-04-01 00:00:00")
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda g, u, h: {"publisherCode": "FOX_WORLD", "publisherName": "Fox News", "country": "US", "politicalLeaning": "CONSERVATIVE", "category": "WORLD", "headline": h, "url": u, "rssGuid": g, "publishedAt": "2026-04-08T10:00:00"}
    # the second row is dropped by the first, so the third, which shares its address alone, stays
    first = [row("g1", "https://n.com/1", "one"), row("g1", "https://n.com/2", "two"), row("g3", "https://n.com/2", "three"), row("g3", "https://n.com/2", "three")]
    (folder / "a.json").write_text("\n".join(map(json.dumps, first)))
    events = []
    p = Pipeline(spark, s)
    p.bus.register(events.append)
    for _ in range(2):
        ingest_stream(p, str(folder), str(tmp_path / "checkpoint"), datetime(2026, 4, 8, 12)).awaitTermination(120)
    assert {r["headline"] for r in s.read("article").collect()} == {"one", "three"}
    saved = [e for e in events if e.step == "ARTICLE_SAVE"]
    assert len(saved) == 1 and "2건, 중복 2건, 실패 0건" in saved[0].message


def test_running_sums(spark):
    rows = [(i % 7, i, None if i % 5 == 0 else i) for i in range(200)]
    d = spark.createDataFrame(rows, "a int, b int, v int").repartition(5)
    got = with_running(d, ["a", "b"], n=F.lit(1), total=F.col("v")).collect()
    want, total = {}, 0
    for n, (a, b, v) in enumerate(sorted(rows, key=lambda r: r[:2])):
        want[(a, b)] = (n, total)
        total += v or 0
    assert {(r["a"], r["b"]): (r["n"], r["total"]) for r in got} == want
    assert with_running(d.where("false"), ["a"], n=F.lit(1)).count() == 0
    numbered = read.numbered(d, F.desc("b")).orderBy("n").collect()
    assert [(r["n"], r["b"]) for r in numbered[:2]] == [(1, 199), (2, 198)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(500, 400), (450, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6), stash).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)} | {400: 400, 450: 400, 500: 400}
