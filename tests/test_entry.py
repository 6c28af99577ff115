"""The driver's entry without the training-data subpackage; valid whether or not it is installed."""

import importlib.abc
import sys

import pytest

import __spark_entry__ as entry


class _Hidden(importlib.abc.MetaPathFinder):
    def __init__(self, error_name=None):
        self.error_name = error_name

    def find_spec(self, name, path, target=None):
        if name == "corpus_pipeline" or name == "marketlens.llm" or name.startswith("marketlens.llm."):
            raise ModuleNotFoundError(f"No module named {self.error_name or name!r}", name=self.error_name or name)


def _hide(monkeypatch, error_name=None):
    import marketlens
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("marketlens.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delattr(marketlens, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [_Hidden(error_name), *sys.meta_path])


def test_library_queries_stay_without_the_subpackage(monkeypatch):
    from marketlens.plans.registry import QUERIES
    _hide(monkeypatch)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)


def test_other_import_errors_are_raised(monkeypatch):
    _hide(monkeypatch, "some_dependency")
    with pytest.raises(ModuleNotFoundError, match="some_dependency"):
        entry.queries()


def test_every_library_query_has_sql():
    from marketlens.plans.registry import QUERIES
    assert set(QUERIES) <= set(entry.oracle_sql())
