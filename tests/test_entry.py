"""The repository stands without the training-data subpackage, its tests and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'), len(e.queries()) >= 130, len(e.oracle_sql()) >= 130)"


def answer(folder, code=ASK):
    env = {**os.environ, "PYTHONPATH": f"{folder}:{folder}/tests"}
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return run.stdout.strip()


def copied(tmp_path, *without):
    folder = tmp_path / "repo"
    shutil.copytree(REPO, folder, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.relpath(os.path.join(d, n), REPO) in without])
    return folder


@pytest.mark.parametrize("without", [
    ("corpusgauge/llm", "tests/llm"), ("corpusgauge/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, without):
    folder = copied(tmp_path, *without)
    assert answer(folder) == "[] True True"
    names = [n[:-3] for n in os.listdir(folder / "tests") if n.startswith("test_") and n.endswith(".py")]
    answer(folder, "import " + ", ".join(sorted([*names, "bench"])))


def test_without_one_library(tmp_path):
    """An import that fails inside the subpackage leaves the other queries."""
    folder = copied(tmp_path)
    blocked = "import sys; sys.modules['xxhash'] = None; sys.modules['tiktoken'] = None; sys.modules['regex'] = None; "
    assert answer(folder, blocked + ASK) == "[] True True"
