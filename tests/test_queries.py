import pytest

from loomgraph.plans import CORE_QUERIES, CORE_SQL
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_as_sql(spark, duck, small, name):
    assert differences(spark, duck, name, small, CORE_QUERIES[name], CORE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(CORE_QUERIES) - set(CORE_SQL)))
def test_runs(spark, small, name):
    assert CORE_QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_without_llm():
    import ast
    from pathlib import Path

    import loomgraph

    root = Path(loomgraph.__file__).parent
    for f in root.rglob("*.py"):
        if (root / "llm") in f.parents:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in named), f
