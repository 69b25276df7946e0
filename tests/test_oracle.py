"""Every registered query against its SQL equivalent."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sievework.plans import ORACLES as SQL, QUERIES
from tests.oracle import compare, connect

# Queries whose result may be empty at the smallest size.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem, rows = compare(spark, con, sf_dir, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0 or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"category", "n_rows", "n_prompts", "median_score"}


@pytest.mark.parametrize("missing", ["sievework.llm", "corpus_pipeline", "ahocorasick", "public_tokenizers"])
def test_entry_works_without_the_optional_part(missing):
    """Neither the training-data operators nor the libraries that only they use need be there."""
    script = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))], done.stderr[-500:]
