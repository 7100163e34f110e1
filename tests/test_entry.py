"""The driver contract, and every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from verification.compare import compare, database
from verification.hashed import ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_flagship_query(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "rank", "document_id", "score"] and frame.count() > 0


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    verdict = compare(spark, connection, SF_DIR, name)
    assert verdict.startswith("OK"), verdict
