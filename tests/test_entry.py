"""The entry module without the training-data subpackage, or without something that it needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("broken", ["removed", "dependency"])
def test_core_queries_stay(tmp_path, broken):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *(["llm", "corpus_pipeline.py"] if broken == "removed" else [])))
    (tmp_path / "other").mkdir()
    if broken == "dependency":
        (tmp_path / "other" / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); print('fetch_markdown' in q, any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": f"{tmp_path / 'other'}:{copy}"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr
