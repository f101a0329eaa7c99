"""The entry without the optional operators."""

import importlib.abc
import sys

import pytest

import __spark_entry__ as driver

OPTIONAL = ("skyframe.llm", "corpus_pipeline")


class Hidden(importlib.abc.MetaPathFinder):
    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if any(name == hidden or name.startswith(f"{hidden}.") for hidden in self.names):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("hidden", [OPTIONAL, OPTIONAL[:1], ("skyframe.llm.queries",)])
def test_queries_without_the_optional_part(monkeypatch, hidden):
    for name in list(sys.modules):
        if name.startswith(OPTIONAL):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden(*hidden), *sys.meta_path])
    names = driver.queries()
    assert len(names) > 170 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(driver.oracle_sql()) <= set(names)
