"""Registered queries against their SQL on the smallest data. Set ROLECALL_ALL_QUERIES=1 to check every one."""
import os

import duckdb
import pytest

from rolecall.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
CORE = ["site_link_counts", "page_job_links", "careers_candidates", "url_key", "text_clean", "workplace_of", "facet_counts_filtered",
        "region_union", "sorted_page", "text_search_index", "posting_lifecycle", "posting_upsert", "migrated_links", "board_rows",
        "feed_lever", "stream_ingest", "export_csv"]
NAMES = sorted(QUERIES) if os.environ.get("ROLECALL_ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("test data not here")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = plain(df.collect(), df.columns, sorted(df.columns))
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert got == plain(want.fetchall(), want.columns, sorted(df.columns))


def test_every_query_has_sql_and_a_schema():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 140
