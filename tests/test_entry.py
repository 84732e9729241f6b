"""The entry without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from nameshift.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_optional_folders(tmp_path, also):
    left_out = {"llm", "__pycache__", ".git", *also}
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda _, names: left_out & set(names))
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[0]) == len(QUERIES)


def test_an_unrelated_import_error_is_not_swallowed(tmp_path):
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda _, names: {"llm", "__pycache__", ".git"} & set(names))
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "a_module_that_is_not_there" in run.stderr
