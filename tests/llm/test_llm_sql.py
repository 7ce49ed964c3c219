"""The queries that SQL can say, against it; the others against themselves."""

from __future__ import annotations

import pytest

from skein.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.SQL[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 1 + len(queries.QUERIES)))
