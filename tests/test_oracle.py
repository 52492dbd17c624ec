"""Every query that SQL can express gives what DuckDB gives."""

import pytest
from helpers import of_duck, of_spark

from cairn.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert of_spark(catalogue.QUERIES[name](spark, sf)) == of_duck(duck, catalogue.ORACLE_SQL[name])
