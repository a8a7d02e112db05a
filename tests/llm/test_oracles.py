"""The training-data queries that SQL can express, against it over whole tables."""

import pytest

from oracle import hold
from spanmill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    hold(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
