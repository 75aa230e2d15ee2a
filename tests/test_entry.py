import os

import duckdb
import pytest

import __spark_entry__ as driver
from logradex.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents pages benchmark labels".split()
SOME = ["match_dn01", "interp_da01", "match_pn01", "ties_resolved", "cep_lookup", "nearest_within", "gazetteer_trimmed_mean"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    cell = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(driver.oracle_sql()[name]).df()
    got = driver.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(core.QUERIES) <= set(driver.queries())
