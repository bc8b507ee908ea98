"""The registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, ordered

FOLDER = "/root/testdata/sf0.001"
# Cheap ones of every area; ``check.py`` compares all of them.
NAMES = [
    "bm25_phrase", "term_options", "batch_search", "direct_deps", "leaderboard_in", "closure_counts", "shortest_path",
    "expand_links", "graph_from_records", "license_norm", "maintainer_norm", "merge_variants", "bridge_maintainer_any",
    "fetch_documents", "request_params", "rolling_quota", "batch_slots",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(entry.ORACLE) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, FOLDER).toPandas(), db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert isinstance(ours, pd.DataFrame) and ordered(ours) == ordered(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
