"""The queries that have SQL, against it."""

import pytest

from lorebase.llm import queries
from tests.conftest import SF
from tests.test_catalogue import rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sql, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), sql.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
