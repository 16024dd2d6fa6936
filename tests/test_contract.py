"""The registered queries agree with their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "clean_text", "standards_join", "prose_citations", "caption_grammar", "list_markers", "dedupe_last_wins", "upsert_merge",
    "link_resolution", "answered_pairs", "hybrid_search_top10",
]


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(_plain(row[names.index(c)]) for c in sorted(names)) for row in result.fetchall())
    frame = contract.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    got = sorted(tuple(_plain(row[c]) for c in sorted(names)) for row in frame.collect())
    assert got and got == want
