import pytest

import __spark_entry__
from quillon import queries
from tests import oracle


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    found = oracle.spark_rows(queries.QUERIES[name](spark, f"{oracle.ROOT}/sf0.001"))
    if name in queries.ORACLES:
        assert found == oracle.duck_rows(queries.ORACLES[name], "sf0.001")
    else:
        assert found[1]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
