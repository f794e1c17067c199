"""Every registered query against its check SQL."""

import os
import subprocess
import sys

import pytest
from comparison import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, con):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF_DIR)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) == []


def test_entry_judges_six_checks(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("gone", ["vouchsafe.llm", "corpus_pipeline", "tokenizers"])
def test_entry_works_without_the_training_data_operators(gone):
    """The driver may remove that subpackage and the pipeline, and a machine may lack what they need."""
    code = (
        f"import sys; sys.modules[{gone!r}] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'gate_suite' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(n.startswith('op') for n in e.queries())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
