import ast
import pathlib

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_the_flagship_query_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "chunk_id", "position", "score"] and df.count() >= 0
