import os

import duckdb
import pytest

from prismark.operators import comparison
from prismark.plans.catalog import ORACLES, QUERIES
from prismark.plans.views import long_pairs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plain(rows):
    def value(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLES:
        theirs = duck.execute(ORACLES[name])
        names = [d[0] for d in theirs.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain(rows) == plain([r[i] for i in order] for r in theirs.fetchall())


def test_bootstrap_numpy_draws_the_full_number_of_replicates(spark):
    pairs = long_pairs(spark, SF).select("id", "metric", "baseline", "candidate")
    assert plain(QUERIES["bootstrap_numpy"](spark, SF).collect()) == plain(comparison.bootstrap_numpy(pairs, ["metric"], samples=2000).collect())
