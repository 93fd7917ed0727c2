"""Fill-in-middle: cuts, forms and round trips against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newslens.llm import fill_in_middle as fim

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = LINE.findall(t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    piece = lambda: r.choice(["a", "é", "日本", "\n", "\n\n", " ", "<", "<P", "P>", ">", "S", "<M", "\r", "😀", "\x00"])
    out = [None, "", "\n", "x", "no newline", "ends\n", "\n\n\n", "<P>", "a<S>b\n", "x\n<M>", "<\nP>", "<" * 9 + "P", "é\n" * 5, "line\n" * 30_000 + "x" * 1_000_000]
    return out + ["".join(piece() for _ in range(r.randint(1, 60))) for _ in range(400)] + ["same\ntext\n"] * 5


def test_equal_to_plain_version(spark, texts):
    rows = [(None if i == 20 else i, t, "clash", i) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, output string, extra long")
    made = fim.fill_in_middle(d)
    assert made.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = fim.restored(F.col("output"), F.col("form")).alias("back")
    got = {x["extra"]: x for x in made.select("*", back).collect()}
    for doc_id, t, _, i in rows:
        x = got[i]
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == plain(doc_id, t)
        assert x["back"] == (t or "")
    assert {x["form"] for x in got.values()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(d.limit(0)).count() == 0


def test_kernel_on_slices(texts):
    """Slices of a batch give what the texts give one by one."""
    draws = np.random.default_rng(1).integers(0, 2**32, (len(texts), 4))
    whole = pa.array(texts)
    for a, b in ((0, len(texts)), (1, 9), (7, 7), (15, 60)):
        parts = fim.transform(whole.slice(a, b - a), draws[a:b])
        each = [fim.transform(pa.array([t], pa.string()), draws[k : k + 1]) for k, t in enumerate(texts[a:b], a)]
        for k in range(4):
            assert parts[k].tolist() == [x[k][0] for x in each]
        assert parts[4].to_pylist() == [x[4][0].as_py() for x in each]
