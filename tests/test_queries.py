"""Every query of the library against its SQL on the smallest tables."""

import pytest

from tests.conftest import SMALL, same_rows
from tidemark.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(name, spark, duck):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_imports_without_text_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
