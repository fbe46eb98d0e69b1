"""The entry module works when the llm folders and the pipeline are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_import(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPO, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_km' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
    # the rest's tests run there too; those of queries are the longest and are the same code
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_functions.py", "tests/test_queries.py", "-q", "-x", "-k", "not matches_sql or q_km"], cwd=tmp_path / "r", check=True, timeout=600)


def test_nothing_else_imports_llm():
    for p in (REPO / "quillmark").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "quillmark.llm" not in p.read_text()
