import math
from collections import Counter

import duckdb
import pytest

from codeloom.plans.queries import SQL, Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q))
def test_query_equals_its_sql(name, spark, con):
    df = Q[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(_plain(x) for x in r) for r in cur.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in names) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(Q) == set(SQL)
