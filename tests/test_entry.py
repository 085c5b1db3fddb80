"""The entry module: names, SQL, and what remains without the corpus operators."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_is_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship_query_runs(spark):
    assert entry.entry(spark).columns == ["facet", "value", "n", "place"]


def test_imports_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['cladeflow.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
