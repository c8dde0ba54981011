"""Every registered query at the smallest scale, beside its SQL where there is one."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, name, entry.queries()[name],
                             entry.oracle_sql().get(name), SF)
    assert ok, note


def test_entry_has_one_row_per_take(spark):
    assert entry.entry(spark).count() == 200


def test_the_rest_loads_without_the_text_operators(monkeypatch):
    import importlib
    import importlib.util
    real = importlib.util.find_spec

    def find_spec(name, *more):
        if name.startswith(("wordreel.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *more)

    try:
        monkeypatch.setattr(importlib.util, "find_spec", find_spec)
        left = importlib.reload(entry).queries()
        assert "summary" in left and "pipeline" not in left
        assert not any(n.startswith("op") for n in left)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
