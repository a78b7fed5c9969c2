"""Every registered query of the route analytics: against its SQL, or that it runs."""

from __future__ import annotations

import pytest
from comparing import of_spark, of_sql

from sparkway import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, data, name):
    assert of_spark(catalog.QUERIES[name](spark, data)) == of_sql(catalog.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
