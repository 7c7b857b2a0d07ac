"""Every base query against its SQL, and the registration of all."""

import subprocess
import sys

import pytest

from tabulora.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['tabulora.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
