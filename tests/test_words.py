"""The tokeniser's expressions against its Python form, which takes the texts that they can't."""

import random

from pyspark.sql import functions as F

from newslens.functions import text, tokens, words

PIECES = (
    "trade war", "trade", "war", " ", "  ", "\n", "U.S.", "u.s", "it's", "boss'", "s’ ", "'s", "5 percent", "7%", "3.5 percentage points", "2024", "1999x", "1,234.5", "12a",
    "트럼프", "트럼프가", "네타냐후는", "은", "가", "나", "é", "É", "ﬁ", "½", "…", "a…b", "ﾊ", "ｶﾞ", "㈱", "™", "ß", "ǅ", "İ", "日本", "。", "running", "ended", "classes", "boss", "nations",
    "admissions", "stopped", "added", "bbings", "bbing", "kings", "goes", "imposed", "tariffs", "us", "USA", "america's", "a", "I", "😀", "𝐀𝐁", "\xa0", "́", "ᄀ", "ᅡ", "_x_", "foo_bars", "num_pct",
    "١٢", "４％", "ios", "Å", "x́",
)


def test_equal_to_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) + r.choice(["", " "]) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "\x1c", "x" * 100_000 + "ings", "trade a war b c deal"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    odd = 0
    for x in df.select("x", text.tokenize(F.col("x")).alias("t"), F.lower("x").alias("low"), text.is_blank(F.col("x")).alias("blank"), words.needs_python(F.col("x")).alias("odd")).collect():
        assert x["t"] == ([] if x["blank"] else tokens.tokens_of(x["low"])), x["x"]
        odd += bool(x["odd"])
    assert 300 < odd < 2500


def test_ascii_stays_in_the_jvm(spark):
    """Python gets a null for a text of ASCII or accented letters."""
    df = spark.createDataFrame([("Plain words, 5 percent.",), ("naïve señor",), ("한국 뉴스 2024년",), ("a ﬁ ligature",)], "x string")
    assert [r["o"] for r in df.select(words.needs_python(F.lower("x")).alias("o")).collect()] == [False, False, False, True]
