"""Every stage of the pipeline against plain versions, on odd rows and empty folders."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from newslens.llm import bpe, mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(folder, texts, ids=None, sources=None, trusted=30):
    n = len(texts)
    t = pa.table({
        "doc_id": pa.array(ids if ids is not None else range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n, pa.string()),
        "source": pa.array(sources if sources is not None else [f"s{i % 3}" for i in range(n)], pa.string()), "n_chars": pa.array([len(x or "") for x in texts], pa.int64()),
        "extra": pa.array(range(n), pa.int64()),
    })
    pq.write_table(t, folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(trusted), pa.int64()), "quality": pa.array([1] * trusted, pa.int32()), "toxic": pa.array([0] * trusted, pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    fresh = lambda: " ".join(word() for _ in range(r.randint(30, 80)))
    clean = [fresh() for _ in range(60)]
    texts = [*clean, clean[0] + " tail", clean[1], clean[2][:-3], None, "", "too short", fresh() + " write to a.b@c.org", fresh() + " call +1 234 567 8901", clean[7], "spam " * 90]
    ids = [*range(60), 60, 61, 62, 63, 64, 65, 66, 67, 7, 69]
    sources = [None if i % 11 == 0 else f"s{i % 3}" for i in range(len(texts))]
    return write(tmp_path_factory.mktemp("pipeline"), texts, ids, sources)


def rows(df):
    return Counter(tuple(r[c] for c in cp.COLUMNS) for r in df.collect())


def sets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.quality_stage(spark, docs, folder)
    verdicts = {(r["doc_id"], r["text"]): r["kept"] for r in quality.quality_rules(docs.select(*cp.COLUMNS), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert rows(kept) == Counter(x for x in rows(docs.select(*cp.COLUMNS)).elements() if verdicts[x[0], x[1]]) and kept.columns == list(cp.COLUMNS)
    assert sum(rows(kept).values()) >= 64

    one = cp.duplicate_stage(spark, kept, folder)
    left = sorted(rows(kept).elements(), key=lambda x: x[0])
    groups = []  # transitive groups of rows
    for x in left:
        s = sets_of(x[1])
        near = [g for g in groups if any(100 * len(s & t) >= 80 * len(s | t) for _, t in g)]
        groups = [g for g in groups if g not in near] + [[m for g in near for m in g] + [(x, s)]]
    assert rows(one) == Counter(g[0][0] for g in (sorted(g, key=lambda m: m[0][0]) for g in groups))

    hidden = cp.pii_stage(spark, one, folder)
    want = Counter()
    for r in pii.find_pii(one).collect():
        out, at = "", 0
        for x in sorted(r["spans_found"], key=lambda x: (x["s"], -x["e"], x["kind"])):
            if x["e"] > at:
                out += r["text"][at : x["s"]] + f"[{x['kind'].upper()}]" if x["s"] >= at else ""
                at = x["e"]
        text = out + r["text"][at:]
        want[(r["doc_id"], text, r["lang"], r["source"], len(text))] += 1
    assert rows(hidden) == want and not any(re.search(r"@c\.org|\+1 234", x[1]) for x in want) and any("[EMAIL]" in x[1] for x in want)

    mixed = cp.mixing_stage(spark, hidden, folder)
    times = rows(mixed)
    assert set(times) <= set(rows(hidden)) and max(times.values()) <= 3
    target = {r["source"]: r["target"] for r in mixing.mix(hidden).collect()}
    words = Counter()
    for x, n in times.items():
        words[x[3]] += n * len(WORD.findall(x[1]))
    longest = max(len(WORD.findall(x[1])) for x in rows(hidden))
    assert all(abs(words[s] - t) <= longest + 0.05 * t for s, t in target.items())

    v = bpe.vocabulary(bpe.default_path())
    ids = Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in cp.bpe_stage(spark, mixed, folder).collect())
    assert ids == Counter((x[0], v.encode(x[1]), len(v.encode(x[1])) // 4) for x in times.elements())
    whole = Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in cp.run(spark, folder).collect())
    assert whole == ids


def test_empty_and_rejected(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "bad").mkdir()
    assert cp.run(spark, write(tmp_path / "none", [], trusted=0)).count() == 0
    assert cp.run(spark, write(tmp_path / "bad", ["short", None, "", "one two"], trusted=0)).count() == 0


def test_odd_rows(spark, tmp_path):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("pqrst") for _ in range(5)) for _ in range(40))
    a, b = text(), text()
    folder = write(tmp_path, [a, a, b, b, text() * 200, None], [None, 1, 2, 2, None, None], [None] * 6, trusted=0)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("x"))
    kept = cp.quality_stage(spark, docs, folder)
    assert Counter(x[0] for x in rows(kept).elements()) == Counter({None: 1, 1: 1, 2: 2})  # the long text repeats itself
    one = cp.duplicate_stage(spark, kept, folder)
    assert Counter(x[0] for x in rows(one).elements()) == Counter({None: 1, 1: 1, 2: 1})
    assert cp.bpe_stage(spark, cp.mixing_stage(spark, cp.pii_stage(spark, one, folder), folder), folder).count() >= 1
