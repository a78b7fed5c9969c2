"""Views: tasks grow in number, not in rows."""

from __future__ import annotations

import pytest

from sparkway.sources import views


@pytest.mark.parametrize("view", ["edges", "plans"])
def test_grouped_views_are_dealt_by_their_rows(spark, data, monkeypatch, view):
    whole = {tuple(r) for r in getattr(views, view)(spark, data).collect()}
    monkeypatch.setattr(views, "ROWS_A_TASK", 500)
    rows = getattr(views, view)(spark, data)
    assert rows.rdd.getNumPartitions() == views.table(spark, data, "lineitem").count() // 500 + 1
    assert "SortAggregate" not in rows._jdf.queryExecution().toString()
    found = [tuple(r) for r in rows.collect()]
    assert set(found) == whole and len(found) == len(whole)
