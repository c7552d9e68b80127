"""The rest of the library stands without the training-data subpackage."""

import ast
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_else_imports_it():
    for path in (ROOT / "colloquy").rglob("*.py"):
        if "llm" not in path.parts:
            assert not [m for m in imports(path) if m.startswith("colloquy.llm")], path


def test_entry_needs_no_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("missing", ["corpus_pipeline", "colloquy.llm", "public_tokenizers", "tokenizers"])
def test_entry_without_the_subpackage_or_what_it_needs(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
