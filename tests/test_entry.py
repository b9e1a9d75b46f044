"""The entry imports without the subpackage, even where a folder of leftovers stands in its place."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_without_the_subpackage(tmp_path, leftover):
    shutil.copytree(ROOT / "spanwise", tmp_path / "spanwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover:
        (tmp_path / "spanwise" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
