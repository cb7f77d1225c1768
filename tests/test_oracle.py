"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from codelantern.plans import oracle, registry
from tests.compare import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(result, duck, SQL[name]) == []
    else:
        assert result.count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(oracle.oracle_sql()) == set(registry.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_the_rest_works_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['codelantern.llm'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries()); assert 'hybrid_search' in names and set(e.oracle_sql()) == names\n"
        "assert not [n for n in names if n.startswith('op') or n == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
