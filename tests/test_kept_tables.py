"""Kept counts, the trigram index, the event table and answers kept by prompt."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newslens import schema
from newslens.operators import dashboard, generate, read, rollup, search
from newslens.plans.event_table import EventTable
from newslens.plans.events import Event, EventBus
from newslens.plans.pipeline import Pipeline
from newslens.sources.counted import CountedStore
from newslens.sources.shared import stash
from newslens.sources.tables import Store, seed


def _fill(store, spark, r, first):
    at = lambda: datetime(2026, 4, 8) + timedelta(hours=12 * r.randint(-2, 4), minutes=r.choice([0, 0, 7]))
    store.append("article", spark.createDataFrame([(i, "h", "h", "u", f"u{i}", None, None, r.choice([1, 2, 3]), "WORLD", None, f"k{i}", at()) for i in range(first, first + 20)], schema.TABLES["article"]))
    store.append("topic", spark.createDataFrame([(i, "t", None, None, None, None, "WORLD", r.choice(["ACTIVE", "PENDING"]), None, at()) for i in range(first, first + 10)], schema.TABLES["topic"]))
    step = lambda i: (i, 1, "COMPLETED", r.choice(schema.RUN_STATUSES), None, None, 0, 0, 0, None, None, None, at(), at())
    store.append("pipeline_step_history", spark.createDataFrame([step(i) for i in range(first, first + 15)], schema.TABLES["pipeline_step_history"]))


def _same(store, spark):
    counts, steps = store.counts(), store.read("pipeline_step_history")
    publishers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, name string")
    named = store.read("article").join(publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name")), "publisher_id")
    assert rollup.articles_by_publisher(counts, publishers).collect() == dashboard.articles_by_publisher(named).collect()
    for day in ("2026-04-07", "2026-04-08", "2026-04-09", "2027-01-01"):
        assert rollup.summary(counts, steps, day).collect() == dashboard.summary(store.read("article"), store.read("topic"), steps, steps, day).collect()
        assert rollup.status_histogram(counts, day).collect() == dashboard.status_histogram(steps, day).collect()


def test_counts_equal_a_scan_after_appends_updates_and_deletes(spark, tmp_path):
    r = random.Random(2)
    s = CountedStore(spark, str(tmp_path))
    for k in range(2):
        _fill(s, spark, r, 100 * k)
    _same(s, spark)
    changed = s.read("topic").where("id < 5").withColumn("status", F.lit("ARCHIVED")).withColumn("created_at", F.lit("2026-04-09 00:00:00").cast("timestamp_ntz"))
    s.update_latest("topic", changed)
    s.update_latest("article", s.read("article").where("id IN (3, 104)").withColumn("publisher_id", F.lit(2).cast("long")))
    s.delete("article", 7)
    Store.append(s, "article", s.read("article").where("id = 1").withColumn("id", F.lit(999).cast("long")))  # lost before its counts were kept
    Store.append(s, "topic", s.read("topic").where("id = 6").withColumn("status", F.lit("PENDING")))
    _same(s, spark)
    assert s.read("daily_count").where("source = 'article'").select("version").distinct().count() > 1


def test_store_searches_what_it_holds(spark, tmp_path):
    s = CountedStore(spark, str(tmp_path))
    row = lambda i, h: (i, h, "h", "u", f"u{i}", None, None, 1, "WORLD", None, f"k{i}", datetime(2026, 4, 8))
    rows = lambda *x: spark.createDataFrame([row(*y) for y in x], schema.TABLES["article"])
    s.append("article", rows((1, "Oil price"), (2, "no"), (3, "OIL again")))
    s.append("article", rows((64, "boiling"), (65, "else")))
    found = lambda n: sorted(r["id"] for r in s.search(n).collect())
    assert (found("oil"), found("no"), found("nothing")) == ([1, 3, 64], [2], [])
    Store.append(s, "article", rows((70, "soil")))  # lost before its grams were kept
    assert found("oil") == [1, 3, 64, 70] and found("oi") == [1, 3, 64, 70]
    s.update_latest("article", rows((3, "gas again")))
    s.delete("article", 64)
    assert found("oil") == [1, 70] and found("gas ") == [3]


def test_search_by_index(spark, tmp_path):
    r = random.Random(9)
    texts = ["".join(r.choice(["a", "B", "é", "ß", "%", "_", "가", " ", "x", "İ"]) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, "", "ab", "100% sure_thing"]
    a = spark.createDataFrame([(i * 7 if i == 303 else (-1) ** i * (2**62 + 7 * i), t) for i, t in enumerate(texts)], "id long, headline string")
    index = stash(search.trigram_index(a.where("id % 2 = 0")).unionByName(search.trigram_index(a.where("id % 2 <> 0"))))  # two appends
    for needle in ("100%", "e_t", "%", "_", "ab", "aBé", "é가x", "ss", "SSx", "no such", "sure_thing", *(t[3:8] for t in texts[:25] if t and len(t) > 8)):
        if needle:
            want = {x["id"] for x in a.where(read.contains_ignoring_case(F.col("headline"), needle)).collect()}
            assert {x["id"] for x in search.search(a, index, needle).collect()} == want, needle
    one = search.candidates(index, search.grams_of(spark, "sure_thing"))
    assert [x["id"] for x in one.collect()] == [303 * 7]
    assert search.trigram_index(a.limit(0)).count() == 0


def test_index_reads_few_rows(spark, tmp_path):
    a = spark.range(20_000).select("id", F.concat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") == 777, " xyzzyq")).alias("h")).withColumn("headline", F.coalesce("h", F.sha2(F.col("id").cast("string"), 256)))
    search.trigram_index(a).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    found = search.candidates(index, search.grams_of(spark, "xyzzyq"))
    assert [x["id"] for x in found.collect()] == [777]
    assert "In(gram" in found._jdf.queryExecution().executedPlan().toString()
    assert index.where(F.col("gram").isin(search.grams_of(spark, "xyzzyq"))).count() < 10 < index.count() / 1000


def test_events_as_a_stream(spark, tmp_path):
    bus, table = EventBus(), EventTable(spark, str(tmp_path / "e"))
    table.listen(bus)
    q = table.stream().writeStream.format("memory").queryName("seen_events").option("checkpointLocation", str(tmp_path / "c")).start()
    for run in (5, 6):
        for k, step in enumerate(schema.STEPS):
            bus.publish(Event(run, step, "SUCCESS", f"m{k}", 20 * k, error=None if k else "e"))
            if k == 2:
                q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("seen_events").orderBy("run_id", "seq").collect()
    assert [(x["run_id"], x["seq"], x["step"]) for x in seen] == [(run, k, s) for run in (5, 6) for k, s in enumerate(schema.STEPS)]
    again = EventTable(spark, str(tmp_path / "e"))
    again(Event(6, "COMPLETED", "SUCCESS", "late", 100))
    assert again.read().where("run_id = 6").agg(F.max("seq").alias("n")).first()["n"] == len(schema.STEPS)


def _flaky(to):
    class Flaky:
        """Writes down every call; fails for good on one prompt and once on another."""

        model = "flaky"

        def generate(self, prompt):
            import os

            with open(f"{to}/calls", "a") as f:
                f.write(prompt + "\n")
            if prompt == "bad" or prompt == "once" and not os.path.exists(f"{to}/failed"):
                if prompt == "once":
                    open(f"{to}/failed", "w").close()
                raise ValueError("no answer")
            return f"about {prompt}"

    return Flaky()


def test_answers_are_asked_for_once(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "once"), (4, "bad"), (5, "b"), (6, None)], "topic_id long, prompt string")
    kept = str(tmp_path / "answers")
    made = lambda **kw: {r["topic_id"]: (r["ai_summary"], r["error"]) for r in generate.generate_once(asked, kept, _flaky(str(tmp_path)), attempts=2, wait=0.01, **kw).collect()}
    want = {1: ("about a", None), 2: ("about a", None), 3: ("about once", None), 4: (None, "no answer"), 5: ("about b", None), 6: (None, "no prompt")}
    assert made(wave=2, at_once=2) == want
    assert sorted((tmp_path / "calls").read_text().split()) == ["a", "b", "bad", "bad", "once", "once"]
    assert made() == want  # only what failed is asked for again
    assert sorted((tmp_path / "calls").read_text().split()) == ["a", "b", "bad", "bad", "bad", "bad", "once", "once"]


def test_pipeline_with_kept_answers_and_counts(spark, tmp_path):
    s = CountedStore(spark, str(tmp_path / "s"))
    seed(s, "2026-04-01 00:00:00")
    (tmp_path / "b").mkdir()
    rows = [{"publisherCode": c, "publisherName": p, "country": "US", "politicalLeaning": "CONSERVATIVE", "category": "WORLD", "headline": "Story of Iran talks", "url": f"https://n.com/{c}", "publishedAt": "2026-04-08T10:00:00"} for c, p in (("FOX_WORLD", "Fox News"), ("NYT_WORLD", "New York Times"))]
    (tmp_path / "b" / "2026-04-08.json").write_text(json.dumps(rows))
    p = Pipeline(spark, s, summarizer=_flaky(str(tmp_path)), answers=str(tmp_path / "answers"))
    table = EventTable(spark, str(tmp_path / "events"))
    table.listen(p.bus)
    (got,) = p.load_batches(str(tmp_path / "b"), datetime(2026, 4, 8, 12))
    assert (got.totals["saved"], got.summaries) == (2, 1) and s.read("topic").first()["ai_model"] == "flaky"
    assert table.read().count() >= 3 and generate.stored_answers(spark, str(tmp_path / "answers")).count() == 1
    n = rollup.summary(s.counts(), s.read("pipeline_step_history"), "2026-04-08").first()
    assert (n["total_articles"], n["total_topics"]) == (2, 1)
