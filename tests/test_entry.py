"""The driver's entry, with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = "import __spark_entry__ as e, bench; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"


def names(root: Path) -> tuple[int, int]:
    out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout
    n, operators = out.split()
    return int(n), int(operators)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    n, operators = names(tmp_path / "repo")
    assert n > 120 and operators == 0


def test_the_entry_works_where_only_the_folders_are_gone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    n, operators = names(tmp_path / "repo")
    assert n > 120 and operators == 0


@pytest.mark.skipif(not (ROOT / "prospectrum" / "llm").exists(), reason="needs the training-data operators")
def test_a_missing_library_is_no_reason_to_leave_queries_out(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "repo" / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\", name='xxhash')\n")
    with pytest.raises(subprocess.CalledProcessError):
        names(tmp_path / "repo")


def test_nothing_else_imports_them():
    for file in ROOT.rglob("*.py"):
        if "llm" not in file.parts and file.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            lines = [x.strip() for x in file.read_text().splitlines()]
            assert not [x for x in lines if x.startswith(("import ", "from ")) and "llm" in x], file
