"""The driver contract in __spark_entry__.py."""

import importlib.util
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    e = _entry_module()
    df = e.entry(spark)
    assert df.columns == ["feature", "all_mean", "featured_mean", "flagged_mean"]
    assert df.count() == 6
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)


def test_entry_works_without_the_training_data_modules(spark, monkeypatch):
    """With the optional modules gone, the other queries stay."""
    e = _entry_module()
    full = set(e.queries())

    monkeypatch.setattr(e, "_optional", lambda name: None)
    rest = set(e.queries())
    assert len(rest) >= 70 and rest <= full
    assert set(e.oracle_sql()) <= rest


def test_entry_works_without_a_module_that_the_optional_ones_need(monkeypatch):
    import sys
    import pytest

    e = _entry_module()

    def missing(name):
        raise ModuleNotFoundError("No module named 'absent'", name="absent")

    monkeypatch.setattr(e.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="absent"):
        assert len(e.queries()) >= 70
    assert "absent" not in sys.modules
