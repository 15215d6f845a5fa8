"""Every query of the library against its DuckDB twin on the smallest tables."""

import pytest
from conftest import DATA, rows

from tessella.plans.all import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_survives_without_the_text_subpackage(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("tessella.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tessella.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "flagship_windows" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
