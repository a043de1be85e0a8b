"""The library, its queries and its tests stand without the text operators."""

import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_imports_the_text_operators():
    for path in (ROOT / "ledgerlight").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                names = [a.name for a in node.names] + [getattr(node, "module", "") or ""]
                assert not any("llm" in n for n in names), path
