"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 240 and not any(n == 'pipeline' or n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "tree")
