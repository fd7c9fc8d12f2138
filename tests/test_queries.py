"""Every query with an oracle gives the oracle's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

import tramline.queries  # noqa: F401
from tramline.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(shown(v) for _, v in sorted(zip(names, r), key=lambda p: p[0])) for r in cursor.fetchall())
