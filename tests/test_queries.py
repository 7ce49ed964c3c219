"""Every query of the library against its SQL on the same tables."""

from __future__ import annotations

import pytest

from skein.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_alike_twice(name, spark, sf_dir, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf_dir).toPandas(), catalog.QUERIES[name](spark, sf_dir).toPandas())


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
