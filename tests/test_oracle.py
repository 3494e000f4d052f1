"""Every named query against its SQL twin on whole small tables."""

import pytest

import lagframe.plans.article_queries  # noqa: F401
from lagframe.plans.queries import QUERIES, SQL

from .compare import DATA, database, rows


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0
