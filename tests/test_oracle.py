"""Every query that SQL can express equals its oracle; the others return rows."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests import oracle

# The training-data operators have tests of their own; trained students are covered with assertions in test_students.
NAMES = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$|student_", n)}
SQL = {n: sql for n, sql in entry.oracle_sql().items() if n in NAMES}
ROWS_ONLY = sorted(NAMES - set(SQL))


@pytest.fixture(scope="module")
def outcomes(spark, sf_dir):
    """All queries, several at a time: most of a small query's time is waiting."""
    con = oracle.connect(sf_dir)

    def run(name):
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in SQL:
                return oracle.compare(df, con.cursor(), SQL[name])
            return None if df.count() > 0 else "no rows"
        except Exception as error:
            return f"{type(error).__name__}: {error}"

    names = sorted(SQL) + ROWS_ONLY
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(run, names)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(outcomes, name):
    assert outcomes[name] is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_returns_rows(outcomes, name):
    assert outcomes[name] is None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
