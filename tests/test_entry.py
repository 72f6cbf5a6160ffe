import importlib
import os
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "day", "open", "high", "low", "close", "volume", "rolling_mean"]
    assert df.count() > 0


@pytest.mark.parametrize("blocked", ["marketframe.llm", "marketframe.llm.entry", "corpus_pipeline", "public_tokenizers"])
def test_core_queries_without_optional_modules(monkeypatch, blocked):
    """A module that can't be imported takes no core query with it."""
    from marketframe import queries

    for name in list(sys.modules):
        if name.startswith(("marketframe.llm", "corpus_pipeline")):
            monkeypatch.delitem(sys.modules, name)
    import marketframe

    monkeypatch.delattr(marketframe, "llm", raising=False)
    monkeypatch.setitem(sys.modules, blocked, None)
    importlib.invalidate_caches()
    found = entry.queries()
    assert set(queries.QUERIES) <= set(found)
    if blocked.startswith("marketframe.llm"):
        assert set(found) == set(queries.QUERIES)
    if blocked == "corpus_pipeline":
        assert "pipeline" not in found
