"""The entry point with and without the optional folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code: str, folder: Path) -> str:
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout


def test_names_of_sql_are_queries():
    out = run("import __spark_entry__ as e; print(set(e.oracle_sql()) - set(e.queries()), e.catalog.FLAGSHIP in e.queries())", ROOT)
    assert out.split("\n")[0] == "set() True"


def test_works_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "epochal", tmp_path / "epochal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = run("import __spark_entry__ as e; print(len(e.queries()) > 50, any(q.startswith('op') and q[2].isdigit() for q in e.queries()))", tmp_path)
    assert out.split("\n")[0] == "True False"
