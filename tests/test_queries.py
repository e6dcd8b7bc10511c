"""Every query against its SQL, on the smallest tables with all features: the driver's own comparison, kept here."""

import duckdb
import pytest
from cadenza.plans.oracles import ORACLES
from cadenza.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(names)
    return sorted([tuple(str(dict(zip(names, r, strict=True))[n]) for n in order) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == plain(want.fetchall(), want.columns)
