"""The feeds as a data source: side by side, with errors as rows."""

import json
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from newslens import schema
from newslens.plans.pipeline import Pipeline
from newslens.sources.feed_source import FeedSource, items_of
from newslens.sources.feeds import collect, read_xml_feed
from newslens.sources.tables import Store, seed

RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="d"><channel><title>t</title><lastBuildDate>Wed, 08 Apr 2026 10:00:00 GMT</lastBuildDate>
<item><title>Iran talks &amp; more</title><link> https://h.kr/1 </link><description><![CDATA[ ]]></description><content:encoded><![CDATA[<p>full</p>]]></content:encoded><guid isPermaLink="false">00123</guid></item>
<item><title>Broken & bad</title><link>https://h.kr/2</link></item>
<item><title>No link</title><link> </link></item>
<item><title>Dated</title><link>https://h.kr/3</link><pubDate>Tue, 07 Apr 2026 09:30:00 +0900</pubDate></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><updated>2026-04-08T09:00:00Z</updated>
<entry><title>One &amp; all</title><link rel="self" href="https://n.org/self"/><link rel="alternate" href="https://n.org/1"/><id>tag:1</id><published>2026-04-08T10:00:00Z</published><summary>short</summary></entry>
<entry><title type="html">Two</title><link href="https://n.org/2"/><id>tag:2</id><content type="html">body</content></entry></feed>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "HANI_WORLD.xml").write_text(RSS)
    (tmp_path / "NYT_WORLD.xml").write_text(ATOM)
    (tmp_path / "FOX_WORLD.xml").write_text("<html>blocked</html>")
    return tmp_path


def test_one_bad_item_costs_one_row(spark, folder):
    candidates, status = collect(spark, FeedSource(folder=str(folder)), ["HANI_WORLD", "NOPE", "NYT_WORLD", "FOX_WORLD", "CHOSUN_WORLD", "HANI_WORLD"])
    got = [(r["publisherCode"], r["errorType"]) for r in status.collect()]
    assert got == [("HANI_WORLD", None), ("NYT_WORLD", None), ("FOX_WORLD", "RSS_PARSE_ERROR"), ("CHOSUN_WORLD", got[3][1]), ("HANI_WORLD", None)] and got[3][1]
    rows = candidates.orderBy("pos").collect()
    first = [(r["pos"], r["headline"], r["url"], r["description"], r["rssGuid"], r["publishedAt"]) for r in rows if r["pos"] < 1 << 32]
    assert first == [
        (0, "Iran talks & more", "https://h.kr/1", "<p>full</p>", "00123", datetime(2026, 4, 8, 10)), (1, None, None, None, None, None),
        (3, "Dated", "https://h.kr/3", None, "https://h.kr/3", datetime(2026, 4, 7, 0, 30)),
    ]
    assert len(rows) == 8 and {r["publisherName"] for r in rows} == {"Hankyoreh", "New York Times"}
    corrupt = FeedSource(folder=str(folder)).load(spark, ["HANI_WORLD"]).where("kind = 'bad_item'").first()
    assert corrupt["corrupt"].startswith("<item><title>Broken & bad") and corrupt["errorType"] == "RSS_PARSE_ERROR"


def test_same_entries_as_the_xml_reader(spark, folder):
    (folder / "good.xml").write_text(RSS.replace("Broken & bad", "Mended"))
    for name in ("good", "NYT_WORLD"):
        (folder / "CHOSUN_WORLD.xml").write_bytes((folder / f"{name}.xml").read_bytes())
        new, _ = FeedSource(folder=str(folder)).collect(spark, ["CHOSUN_WORLD"])
        columns = ["headline", "url", "description", "rssGuid", "publishedAt"]
        assert sorted(map(str, new.select(*columns).collect())) == sorted(map(str, read_xml_feed(spark, str(folder / f"{name}.xml")).select(*columns).collect()))


def test_odd_feeds():
    assert [k for k, _ in items_of(b"<rss><channel><item><title>x</title></channel></rss>")] == []
    assert list(items_of("<rss><channel><item><title>\xe9</title><link>u</link></item></channel></rss>".encode("utf-8")))[0][1]["title"] == "é"
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><item><title>é</title></item></rss>'.encode("latin-1")
    assert next(items_of(latin))[1]["title"] == "é"
    with pytest.raises(ValueError):
        list(items_of(b""))


class _Slow(BaseHTTPRequestHandler):
    at: list = []

    def do_GET(self):
        began = time.monotonic()
        time.sleep(1.0)
        self.at.append((began, time.monotonic()))
        code = {"/403": 403}.get(self.path, 200)
        self.send_response(code)
        self.end_headers()
        self.wfile.write(RSS.encode())

    def log_message(self, *a):
        pass


def test_four_feeds_side_by_side(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Slow)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = {f[0]: f"{base}/{f[0]}" for f in schema.FEEDS} | {"NYT_WORLD": f"{base}/403"}
    try:
        status = {r["publisherCode"]: r["errorType"] for r in FeedSource("network", urls=urls).collect(spark)[1].collect()}
    finally:
        server.shutdown()
    assert status == {"FOX_WORLD": None, "NYT_WORLD": "RSS_FORBIDDEN", "CHOSUN_WORLD": None, "HANI_WORLD": None}
    assert len(_Slow.at) == 4 and max(a for a, _ in _Slow.at) < min(b for _, b in _Slow.at)  # the last began before the first ended


def test_live_run_and_total_failure(spark, folder, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    seed(store, "2026-04-01 00:00:00")
    p = Pipeline(spark, store)
    run = p.run(FeedSource(folder=str(folder)), datetime(2026, 4, 8, 12))
    # four good entries and a bad one; two feeds failed
    assert (run.totals["fetched"], run.totals["saved"], run.totals["failed"], run.status) == (5, 4, 3, "PARTIAL_FAILED")
    broken = p.run(FeedSource(mode="nothing"), datetime(2026, 4, 8, 13))
    assert (broken.totals["fetched"], broken.totals["saved"], broken.totals["failed"], broken.status) == (0, 0, 1, "FAILED")
    assert json.dumps(store.read("pipeline_step_history").where("target_name = 'ALL_FEEDS'").count()) == "1"
