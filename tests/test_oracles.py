"""Every query that has SQL gives what DuckDB gives on the same tables."""

import duckdb
import numpy as np
import pytest

from quillspark.field_queries import QUERIES
from quillspark.queries import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v else repr(v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(str([plain(dict(zip(names, r))[c]) for c in columns]) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
