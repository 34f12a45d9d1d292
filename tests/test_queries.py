"""Every named query outside llm against its SQL on the smallest tables."""

import os

import pytest

from gleanery.queries import ORACLE_SQL, QUERIES
from tests.compare import spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLE_SQL:
        assert (names, rows) == sql_rows(ORACLE_SQL[name], FOLDER)
    else:
        assert rows
