import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).collect() is not None


@pytest.mark.parametrize("absent", ["spanloom.llm", "public_tokenizers"])
def test_without_the_llm_folders_or_what_they_need(monkeypatch, absent):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(absent):
                raise ModuleNotFoundError(f"No module named '{absent}'", name=absent)

    for name in [n for n in sys.modules if n.startswith(("spanloom.llm", "corpus_pipeline", absent))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    own = importlib.reload(entry)
    try:
        assert not [n for n in own.queries() if n.startswith("op") or n == "pipeline"] and "strict_prf_by_label" in own.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
