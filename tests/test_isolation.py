"""The library without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_works_without_llm(tmp_path):
    for item in ("ocellus", "__spark_entry__.py", "bench.py"):
        at = ROOT / item
        (shutil.copytree if at.is_dir() else shutil.copy)(at, tmp_path / item)
    shutil.rmtree(tmp_path / "ocellus/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "ocellus").rglob("*.py"):
        if "llm" not in path.parts:
            assert "ocellus.llm" not in path.read_text(), path
