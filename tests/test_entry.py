import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("tallyframe/llm",), ("tallyframe/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_load_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT / "tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    from tallyframe.operators import catalogue

    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, sql = map(int, done.stdout.split())
    assert sql >= len(catalogue.ORACLE_SQL) and n == len(catalogue.QUERIES) if "tallyframe/llm" in gone else n >= len(catalogue.QUERIES), done.stderr
