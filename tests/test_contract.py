"""Every query beside its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from heirflow.plans import catalog
from tools.check_oracles import KINDS, TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns[0] == "gross_estate_group" and result.count() > 0


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_twin(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = db.sql(contract.oracle_sql()[name])
    kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(found.columns, found.types)}
    assert kinds == {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert compare([tuple(r) for r in df.select(*columns).collect()], theirs) == "ok"


@pytest.mark.parametrize("name", ["hurdle_impute", "calibrated_summary"])
def test_model_queries(spark, name):
    rows = contract.queries()[name](spark, SF_DIR).collect()
    assert rows
    if name == "hurdle_impute":
        assert all(r["inheritance"] > 0 and r["sigma_pred"] > 0 for r in rows)
    else:
        assert sum(r["n_inheritances"] for r in rows) > 0
