"""The contract of __spark_entry__.py at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).count() == 365


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    return float(value) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", ["report_series", "report_timing", "lifecycle_fold", "rate_limit", "classify_jobs", "split_pages", "option_values", "image_geometry",
                                  "malware_scanners", "live_snapshots", "transform_events", "job_pixels", "prune_table", "report_document_series"])
def test_query_agrees_with_its_sql(spark, name):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    c.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in c.description].index(n) for n in columns]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in c.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in columns) for r in df.collect()), key=repr) == expected
