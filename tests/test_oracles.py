"""Every query against its SQL in another engine, over the whole smallest tables."""


import pytest
from compare import connect, difference

from lectern.plans.oracles import ORACLES
from lectern.plans.queries import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"fit_adapter_losses", "fit_policy_losses"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    described = {row[0]: row[1] for row in con.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in described.items()}
    assert difference(df, con, ORACLES[name]) is None


def test_fits_improve(spark, small):
    for name in ("fit_adapter_losses", "fit_policy_losses"):
        losses = [row["loss"] for row in QUERIES[name](spark, small).orderBy("epoch").collect()]
        assert losses == sorted(losses, reverse=True), name
