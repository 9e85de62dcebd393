"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert set(rows.columns) == {"lang", "source", "type", "n"} and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("kept", [False, True])
def test_without_corpus_operators(tmp_path, kept):
    """With the corpus operators' folders gone, with or without their pipeline, the rest imports and its queries run."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if kept else ["corpus_pipeline.py"])))
    code = """
import __spark_entry__ as e, tests.conftest
q = e.queries()
assert 'detect_counts' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)
spark = next(tests.conftest.spark.__wrapped__())
assert q['email_corpus'](spark, '/root/testdata/sf0.001').count() > 0 and e.entry(spark).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_a_broken_part_is_not_hidden(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
