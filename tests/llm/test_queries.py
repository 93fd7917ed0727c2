"""Operators on small tables: nulls, empty and repeated rows, clashing columns, brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newslens.llm import bpe, chat, html_text, jaccard, mixing, pii, quality, token_counts, topk, url_filters
from newslens.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(40)]
    near = [b + " tail" for b in base[:10]] + base[5:12]
    return [None, "", " \n\t ", "one", "ONE", *base, *near, "x y z " * 60, "a\n\nb\na\n#$%", "\x1fa\x85b" + "q" * 20_000]


def test_words(spark, texts):
    got = docs(spark, texts).select("doc_id", words(F.col("text")).alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in got} == {i: WORD.findall(t or "") for i, t in enumerate(texts)}


def test_quality(spark, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5, 30)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts).withColumn("llr", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality_rules(d, labels).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        repeat = len({k + j for k, x in enumerate(windows) if x in twice for j in range(8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(docs(spark, []), labels).count() == 0


def components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, texts):
    r = random.Random(3)
    rows = list(texts)
    for _ in range(30):  # small sets and a family of near copies
        base = [r.choice("abcdefghij") for _ in range(r.randint(1, 22))]
        rows += [" ".join(base), " ".join([*base, "k"]), " ".join(base[1:])]
    family = [str(r.randint(0, 10**6)) for _ in range(90)]
    for _ in range(60):
        w = list(family)
        w[r.randrange(90)] = f"x{r.randint(0, 99)}"
        rows.append(" ".join(w))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == components(list(enumerate(rows)))
    one = jaccard.one_of_each(docs(spark, ["same text here now ok"] * 3 + [None]).union(docs(spark, ["same text here now ok"])))
    assert sorted(x["doc_id"] for x in one.collect()) == [0, 3]


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((x["doc_id"], x["component_id"]) for x in jaccard.jaccard_components(d).collect()), key=str) == [(1, 1), (1, 1), (None, None)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, tmp_path):
    r = random.Random(5)
    parts = ["a@b.com", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "001.2.3.4", "4111111111111111", "4111 1111 1111 1111", " ", "  ", "-", "+1 (234) 555-6789", "+", "@", ".", "_", "é", "😀", "12", "7", "ab", "@c.d", "1.2.3.4.5.6.7.8", "\n", ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ']
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(300)] + [None, "", "1" * 20_000, "a" * 20_000 + "@", "1 " * 9_000, "a.b." * 5_000 + "@x"]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for x in pii.query(spark, str(tmp_path)).collect():
        t, spans, n = rows[x["doc_id"]] or "", [], []
        for kind, p in BASE.items():
            hits = [m.span() for m in re.finditer(p, t) if _valid(kind, m.group())]
            n.append(len(hits))
            spans += [f"{kind}:{a}:{b}" for a, b in hits]
        assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == tuple(n)
        assert x["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and x["spans"].startswith(",".join(spans))
    got = pii.redact(docs(spark, ["mail a@b.com or 4111 1111 1111 1111.", "clean text, 12 items", None])).orderBy("doc_id").collect()
    assert [g["text"] for g in got] == ["mail [EMAIL] or [CARD].", "clean text, 12 items", None]


def test_mixing(spark, texts):
    d = docs(spark, texts)
    got = mixing.mix(d).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 2
    assert sorted(map(tuple, mixing.mix(d.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [None, ""])).count() == 2
    assert set(mixing.mixture(d).columns) == set(d.columns)


def test_bpe_and_counts(spark, texts):
    v = bpe.vocabulary(bpe.default_path())
    d = docs(spark, texts).withColumn("n_tokens", F.lit(1))
    for r in bpe.encode_documents(d, ids=True).collect():
        t = texts[r["doc_id"]] or ""
        ids = v.encode(t)
        assert (r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_documents(docs(spark, [])).count() == 0
    for r in token_counts.token_counts(d).collect():
        w = (texts[r["doc_id"]] or "").encode().split()
        assert r["n_words"] == len(w) and r["n_unknown"] <= r["n_words"] <= r["n_tokens"]


def test_url_filters(spark):
    urls = [None, "", "x", "http://EXAMPLE.com/en/a", "http://www.example.com/en/?q", "https://a.net/es/1", "https://a.net/esx", "http://com/", "http://com", "http://b.org#x", "http://m.spam-farm.example.org/", "http://notnet/fr/", "http://net/fr/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filters(pages).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("example.com", "/en/a", "example.com/en/", "block"),
        4: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 5: ("a.net", "/es/1", "net/es/", "block"), 6: ("a.net", "/esx", None, "allow"),
        7: ("com", "/", "com/", "allow"), 8: ("com", "", None, "allow"), 9: ("b.org", "", None, "allow"), 10: ("m.spam-farm.example.org", "/", None, "block"),
        11: ("notnet", "/fr/", None, "allow"), 12: ("net", "/fr/", "net/fr/", "block")}
    assert url_filters.url_filters(pages.where("false")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 37)]
    levels = url_filters.build_cascade(universe, listed)
    assert len(levels) > 1 and {r["key"] for r in universe.where(url_filters.member(F.col("key"), levels)).collect()} == set(listed)


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(150)] + [(200, None), (300, [nan] * 5), (400, [inf] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (600, [0.5] * 5), (601, [0.5] * 5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    good = {x["vec_id"]: [int((c * 1024) // 1) for c in x["embedding"]] for x in v.collect() if x["vec_id"] is not None and x["vec_id"] not in (200, 300, 400, 500)}
    got = topk.exact_topk(v, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    want = []
    for q in sorted(k for k in good if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert [tuple(g) for g in got] == want
    assert topk.exact_topk(v.where("false"), F.lit(True)).count() == 0 and topk.exact_topk(v.where("vec_id = 0"), F.lit(True)).count() == 0


def test_html(spark):
    d = spark.createDataFrame([(1, None, None, "t"), (2, "x", "", "t"), (3, "http://a/b", "<p>hi &amp;  ho", "t"), (3, "http://a/b", "<p>hi &amp;  ho", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(d).collect()) == [(1, "", 0), (2, "", 0), (3, "hi & ho", 7), (3, "hi & ho", 7)]
    assert html_text.extract_text(d.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> Hello there\n> How are you?\nFine."), (1, 2, "u", "Unrelated"), (1, 3, "u", "On Monday X wrote:\n> Fine.\n>> hello   THERE\nGood"),
            (1, 4, "a", "> > How are you?\n\nlate"), (2, 0, "u", None), (2, 1, "u", ""), (None, 1, "u", "> x"), (2, None, "u", "hi"), (2, 1, "u", ""), (3, 7, "u", "> nobody said it\nok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    got = sorted((tuple(r) for r in chat.link_quotes(df).collect()), key=str)
    want = [(1, 0, "u", "Hello there\nHow are you?", 0, None, 0, 0, 0), (1, 1, "a", "Fine.", 1, 0, 0, 1, 1), (1, 2, "u", "Unrelated", 0, None, 2, 0, 4), (1, 3, "u", "Good", 2, 1, 0, 2, 2),
            (1, 4, "a", "late", 1, 0, 0, 1, 3), (2, 0, "u", None, 0, None, 0, 0, 0), (2, 1, "u", "", 0, None, 1, 0, 1), (2, 1, "u", "", 0, None, 1, 0, 1), (None, 1, "u", "", 1, None, 1, 0, None),
            (2, None, "u", "hi", 0, None, None, 0, None), (3, 7, "u", "ok", 1, None, 7, 0, 0)]
    assert got == sorted(want, key=str)
    assert chat.link_quotes(df.where("false")).count() == 0


def test_topk_of_repeated_rows(spark):
    r = random.Random(7)
    rows = [(i, [float(r.randint(-9, 9)) for _ in range(3)]) for i in range(40)]
    rows += [rows[0], rows[0], (100, rows[3][1]), (100, [1.0, 2.0, 3.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    scaled = [(i, [int(c * 1024) for c in v]) for i, v in rows]
    want = []
    for at, (q, y) in enumerate(scaled):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(y, x, strict=True)), c) for n, (c, x) in enumerate(scaled) if n != at)[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash"))
    assert 0 < topk.exact_topk(d, F.col("vec_id") == 5, report=True).first()["evaluated"] <= 1


def test_url_filters_by_table(spark):
    r = random.Random(11)
    label = lambda: r.choice("abcd") + r.choice("xyz")
    urls = [f"http://{'.'.join(label() for _ in range(r.randint(1, 4)))}/{'/'.join(r.choice('pqr') for _ in range(r.randint(0, 3)))}?q" for _ in range(400)] + [None, "http://casino-x.ay/p"]
    rules = list({(h, p): (v, h, p) for v, h, p in ((r.choice(["allow", "block"]), ".".join(label() for _ in range(r.randint(1, 2))), r.choice(["/", "/p", "/p/q"])) for _ in range(60))}.values())
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, hit string")
    want = sorted(map(tuple, url_filters.url_filters(pages, tuple(rules)).collect()), key=str)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(tuple, url_filters.url_filters(pages, table).collect()), key=str) == want
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("pmod(xxhash64(key), 30) = 0").union(spark.range(1).select(F.lit("elsewhere").alias("key")))
    got = url_filters.listed_by_table(universe, listed, 20).where("listed").select("key").collect()
    assert {x["key"] for x in got} == {x["key"] for x in listed.collect()} - {"elsewhere"}
    assert not url_filters.listed_by_table(universe, listed.where("false")).where("listed").count()
