"""Every query of the catalogue against its SQL."""

import pytest

from lorebase import catalogue
from tests.conftest import SF


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got)
        return
    want = sql.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
