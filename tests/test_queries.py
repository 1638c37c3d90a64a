"""Every panel query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelmill.plans import application, application_sql, cluster_queries, cluster_sql, more_queries, more_sql, panel_queries, panel_sql

QUERIES, ORACLES = panel_queries.QUERIES | more_queries.QUERIES | cluster_queries.QUERIES | application.QUERIES, panel_sql.ORACLES | more_sql.ORACLES | cluster_sql.ORACLES | application_sql.ORACLES
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
