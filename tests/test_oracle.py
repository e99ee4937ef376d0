"""Every query with SQL gives DuckDB's result."""

import pytest

from compare import differences, duck
from matchlog.oracle import ORACLE
from matchlog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
