"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

from wiretide.plans.queries import ORACLES, QUERIES
from wiretide.plans.views import TABLES


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool | str):
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return int(x) if hasattr(x, "__int__") else str(x)


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        r = db.execute(ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())
