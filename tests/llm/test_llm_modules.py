"""No module defines a name twice: a later definition would shadow the first without a word."""

import ast
from collections import Counter
from pathlib import Path

import pytest

FILES = sorted((Path(__file__).parents[2] / "tessel" / "llm").glob("*.py")) + sorted(Path(__file__).parent.glob("*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.name)
def test_names_are_defined_once(path):
    tree = ast.parse(path.read_text(encoding="utf-8"))
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
        names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert not [name for name, n in names.items() if n > 1]
