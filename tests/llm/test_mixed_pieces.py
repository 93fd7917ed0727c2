"""The mix as pieces of documents."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newslens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pieces_are_the_scheduled_mix(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, "a", "  " + "\n ".join(words[:1000])), (1, "b", " ".join(words[1000:1007])), (2, "b", "one"), (3, None, "\t".join(words[2000:2300])), (4, "c", None), (5, "c", " ")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("clash"))
    planned = mixing.plan_sources(mixing.sized(d))
    plan = sorted(tuple(r[c] for c in ("src", "source", "source_size", "target", "blocks")) for r in planned.collect())
    source_of = {p[0]: p[1] for p in plan}
    slots = {r["slot"]: (source_of[r["src"]], r["block"]) for r in mixing.schedule(planned).collect()}
    got = mixing.mixed_pieces(d).collect()
    assert [(r["slot"], r["start"]) for r in got] == sorted((r["slot"], r["start"]) for r in got)
    assert {r["slot"] for r in got} == set(slots) and all(slots[r["slot"]][0] == r["source"] for r in got)
    texts = {i: t for i, _, t in rows}
    assert all(r["text"] in texts[r["doc_id"]] and len(WORD.findall(r["text"])) == r["n_words"] for r in got)
    # what op9 reports is what is emitted, of each document
    n = Counter()
    for r in got:
        n[r["doc_id"]] += r["n_words"]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()} == {i: n[i] for i in texts}
    # a block is the same whenever it is taken, and the blocks of one round make the documents again
    blocks = defaultdict(set)
    for s in slots:
        blocks[slots[s]].add("".join(r["text"] for r in got if r["slot"] == s))
    assert all(len(x) == 1 for x in blocks.values())
    if len([b for b in blocks if b[0] is None]) == next(p[4] for p in plan if p[1] is None):
        assert "".join(x for b in sorted(b for b in blocks if b[0] is None) for x in blocks[b]) == texts[3]


def test_a_source_of_one_document_stays(spark):
    d = spark.createDataFrame([(0, "a", " ".join(f"x{i}" for i in range(400))), (1, "b", " ".join(f"y{i}" for i in range(120)))], "doc_id long, source string, text string")
    assert mixing.targets([400, 120])[0] < 200  # less than half of it: no whole copy
    want = {r["source"]: r["target"] for r in mixing.mix(d).collect()}
    got = {r["source"]: r["n"] for r in mixing.mixed_pieces(d).groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 0.02 * want[s] + 2 for s in want)
    assert mixing.mixed_pieces(d.where("false")).count() == 0
