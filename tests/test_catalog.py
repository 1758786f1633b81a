"""Every panel query against its SQL on the smallest tables; the others give rows."""

import os

import pytest
from compare import database, same

from epochal import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    same(catalog.queries()[name](spark, SF_DIR), db, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0
