"""Topics by country in parts whose number grows with the links."""

from newslens.operators import dashboard


def test_parts_grow_with_links(spark, monkeypatch):
    links = spark.range(400).selectExpr("id % 60 AS topic_id", "id % 7 AS article_id")
    topics = spark.range(50).withColumnRenamed("id", "id")
    articles = spark.range(6).selectExpr("id", "concat('c', id % 3) AS country")
    want = {}
    for k in range(400):
        if k % 60 < 50 and k % 7 < 6:
            want.setdefault(f"c{k % 7 % 3}", set()).add(k % 60)
    for size, parts in ((500_000, 1), (20, 20)):
        monkeypatch.setattr(dashboard, "LINKS_OF_PART", size)
        made = dashboard.topics_by_country(links, topics, articles)
        assert {x["country"]: x["n"] for x in made.collect()} == {c: len(t) for c, t in want.items()}
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert parts == 1 or f", {parts}), REPARTITION_BY_NUM" in plan
