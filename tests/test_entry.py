from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["query_id", "id", "score", "rank"] and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    for p in ("textloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "textloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_the_library_does_not_import_the_subpackage():
    for p in (REPO / "textloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"textloom\.llm|from textloom import .*llm", p.read_text()), p
