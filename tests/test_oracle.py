"""Each registered query of the frame operators against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pixeltide.plans import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float64", "int64") else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).limit(1).count() == 1
