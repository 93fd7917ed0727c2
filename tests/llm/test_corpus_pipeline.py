"""The corpus pipeline on a small folder."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as cp
from newslens.llm import bpe


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " tail", "mail me@x.org now " + clean[2][20:], "short", None, "spam spam " * 100]
    t = pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": [f"src{i % 2}" for i in range(len(texts))], "n_chars": [len(x or "") for x in texts]})
    pq.write_table(t, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": range(20), "quality": pa.array([1] * 20, pa.int32()), "toxic": pa.array([0] * 20, pa.int32())}), tmp_path / "labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = cp.quality_stage(spark, docs, str(tmp_path))
    assert {x["doc_id"] for x in kept.collect()} >= set(range(30)) and not {33, 34, 35} & {x["doc_id"] for x in kept.collect()}
    one = cp.duplicate_stage(spark, kept, str(tmp_path))
    ids = {x["doc_id"] for x in one.collect()}
    assert not {30, 31} & ids and ids >= set(range(2, 30))
    hidden = cp.pii_stage(spark, one, str(tmp_path))
    assert all(x["n_chars"] == len(x["text"]) and "me@x.org" not in x["text"] for x in hidden.collect()) and hidden.columns == list(cp.COLUMNS)
    assert cp.mixing_stage(spark, hidden, str(tmp_path)).columns == list(cp.COLUMNS)
    v = bpe.vocabulary(bpe.default_path())
    texts_of = {x["doc_id"]: x["text"] for x in hidden.collect()}
    got = cp.run(spark, str(tmp_path)).collect()
    assert got and all(v.decode(bytes(x["ids"])) == texts_of[x["doc_id"]] for x in got)
