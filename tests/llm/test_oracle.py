"""The queries that SQL can express, against DuckDB."""

import pytest

from parcela.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", [*ORACLE_SQL])
def test_oracle(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLE_SQL[name], sf_dir)
