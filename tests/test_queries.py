"""Every query beside its SQL at the smallest scale, and all queries for a stable schema."""

import math

import duckdb
import pytest

from marlpit.plans import queries as plans

TABLES = "documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, tiny, name):
    got = plans.queries()[name](spark, tiny)
    want = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    pick = [names.index(c) for c in sorted(names)]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    left = sorted(([_plain(r[c]) for c in sorted(names)] for r in got.collect()), key=key)
    right = sorted(([_plain(r[i]) for i in pick] for r in want.fetchall()), key=key)
    assert left == right
    assert left


def test_every_query_has_its_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "bm25_topk" in entry.queries()
