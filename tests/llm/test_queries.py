"""The subpackage's queries against their SQL, or just run where SQL has no words for them."""

import pytest

from tabulora.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize(("name", "table"), [("op1_document_fingerprints", "documents"), ("op6_byte_level_bpe", "documents"), ("op7_lm_scoring", "documents"), ("op9_toxicity", "documents")])
def test_query_returns_each_row(spark, name, table):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
