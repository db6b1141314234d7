import sys
from pathlib import Path

import pytest


def test_names_and_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


@pytest.mark.parametrize("gone", ["granary.llm", "ahocorasick"])
def test_without_the_training_operators(monkeypatch, gone):
    """Neither the subpackage nor what it needs has to be there."""
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("granary.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)  # importing it fails
    names = entry.queries()
    assert "bm25_topk" in names and not [n for n in names if n.startswith("p1_")]


def test_nothing_else_imports_them():
    import granary

    root = Path(granary.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "granary.llm" not in path.read_text(), path


def test_flagship(spark):
    import __spark_entry__ as entry

    try:
        rows = entry.entry(spark).collect()
    except Exception as e:  # the test data is not everywhere
        pytest.skip(str(e)[:100])
    assert rows
