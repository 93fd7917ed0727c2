import unicodedata

from pyspark.sql import functions as F

from newslens.functions import text, url


def _apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokenize(spark):
    cases = {
        "트럼프 이란 우라늄 직접 폐기 방침": "donald_trump iran uranium 직접 폐기 방침",
        "네타냐후의 이스라엘에서 레바논을 공습": "netanyahu israel lebanon airstrike",
        "미·이란 휴전 합의": "미 iran cease_fire 합",
        "U.S.-Iran Cease-Fire Deal": "united_states iran cease_fire deal",
        "trump wins us election": "donald_trump win united_states election",
        "trade a war": "trade_war",
        "25 percent of 1,000 in 2026": "NUM_PCT of NUM in NUM_YEAR",
        "negotiations imposing running strikes nations": "negoti impose run strik nation",
        "왕이": "왕", "대만": "대", "대만에서": "taiwan",
        "1990s 1,000% café China’s companies' 2026년": "1990 NUM NUM_PCT cafe china compani " + unicodedata.normalize("NFKD", "NUM_YEAR년"),
        "": "", "  ": "",
    }
    assert [" ".join(t) for t in _apply(spark, text.tokenize, cases)] == list(cases.values())
    assert _apply(spark, text.tokenize, [None]) == [[]]


def test_particles(spark):
    assert _apply(spark, text.strip_particle, ["네타냐후의", "이란에서", "이스라엘이", "트럼프", "이란"]) == ["네타냐후", "이란", "이스라엘", "트럼프", "이란"]


def test_headline_text_html(spark):
    assert _apply(spark, text.normalize_headline, ["Breaking NEWS: Big Event", "U.S. Stocks Rise!", None, "a“b”·c"]) == ["breaking news big event", "u s stocks rise", "", "a“b”·c"]
    assert _apply(spark, text.sanitize_text, ["Iran&apos;s  x &quot;alarming&quot;", "&amp;lt;b&amp;gt;", None]) == ['Iran\'s x "alarming"', "<b>", None]
    assert _apply(spark, text.sanitize_html, ["<p>Some &amp; description</p>", "<img src=x>", " ", None, "a&nbsp;b"]) == ["Some & description", None, None, None, "a b"]


def test_dedupe_key(spark):
    df = spark.createDataFrame([("BBC", "breaking news", "2026-04-08 10:00:00"), ("BBC", "breaking news", None)], "p string, h string, t string")
    got = [r["k"] for r in df.select(text.dedupe_key(F.col("p"), F.col("h"), F.col("t").cast("timestamp_ntz")).alias("k")).collect()]
    assert got == ["692889ea74563bfce58cbe6b4431599b02efbd00698c8ee0e94c87b9b158a692", "fdfb1d7d1d154a735538a6aac033db3f917855920868c88d64a7c588591a313c"]


URLS = {
    "http://example.com/news/article": "https://example.com/news/article",
    "https://example.com/news/": "https://example.com/news",
    "https://example.com/news?id=42&utm_source=google": "https://example.com/news?id=42",
    "https://example.com/": "https://example.com/",
    "http://bbc.com/news/?utm_source=google": "https://bbc.com/news",
    "http://user@EX.com:8080/A/b//?q=%20x&id=1#frag": "https://ex.com/a/b/?q=%20x&id=1",
    "https://ex.com/?outputType=xml": "https://ex.com/?outputtype=xml",
    "https://ex.com/a b": "https://ex.com/a b", "rel": "rel", "https://ex.com/x?=": "https://ex.com/x?=",
    "https://my_host.com/x": "https:/x", "https://ex.com/a%2Fb?x=a%26b": "https://ex.com/a/b?x=a&b", "mailto:a@b.c": "https:/", "/rel/path": "https:/rel/path",
}


def test_urls(spark):
    assert _apply(spark, url.normalize_url, [*URLS, None]) == [*URLS.values(), None]
    assert [url.normalize_one(u) for u in URLS] == list(URLS.values())
