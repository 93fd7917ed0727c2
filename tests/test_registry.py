import os

import pytest

import __spark_entry__ as entry
from newslens import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["topic_list_left", "status_histogram", "dedupe_priority_store", "sanitize_html", "similarity_edges", "summary_prompt"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    want, got = c.execute(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
