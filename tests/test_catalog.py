"""Every registered core query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from support import SF, same

from arcframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "arcframe.llm" not in path.read_text(), path
