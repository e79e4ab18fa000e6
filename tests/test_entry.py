"""The entry with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
OPTIONAL = ("tidewatch/llm", "corpus_pipeline.py")
SHOW = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(*sorted(names))"


def names(folder: Path) -> set[str]:
    return set(subprocess.run([sys.executable, "-c", SHOW], cwd=folder, check=True, capture_output=True, text=True).stdout.split())


@pytest.mark.parametrize("gone", [("tidewatch/llm",), ("tidewatch/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ()])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *[Path(g).name for g in gone]))
    found = names(copy)
    assert "verdicts_by_country" in found
    # The parts may be gone from this folder too.
    there = {part for part in OPTIONAL if (ROOT / part).exists()} - set(gone)
    assert any(n.startswith("op") for n in found) == ("tidewatch/llm" in there)
    assert ("pipeline" in found) == (there == set(OPTIONAL))


def test_entry_with_an_empty_folder(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    (copy / "tidewatch/llm/__pycache__").mkdir(parents=True)
    assert not any(n.startswith("op1_") for n in names(copy))
