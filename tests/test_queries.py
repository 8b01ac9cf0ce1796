"""Each query with SQL gives what DuckDB gives on the same tables; each other one gives rows."""

import math
import os

import duckdb
import pytest

from stylograph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"agg_loo_threshold", "jn_profile_compare", "set_dedup_near"}  # tested on fixtures


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        try:
            return round(float(v), 4)
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
