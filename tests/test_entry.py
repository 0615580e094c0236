"""The entry file with and without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'minimum_slice' in q, 'pipeline' in q, sorted(set(s) - set(q)))"


def shown(folder):
    got = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]
    return got.stdout.strip().splitlines()[-1]


def copied(to, without):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), to)
    shutil.copytree(os.path.join(ROOT, "passagebase"), to / "passagebase", ignore=shutil.ignore_patterns("__pycache__", *without))
    return to


def test_entry_without_the_training_data_part(tmp_path):
    """The folder gone, corpus_pipeline.py still there: all other queries stay."""
    line = shown(copied(tmp_path, ["llm"]))
    assert " True False []" in line


def test_entry_without_the_pipeline_file(tmp_path):
    to = copied(tmp_path, ["llm"])
    os.rename(to / "corpus_pipeline.py", to / "elsewhere.txt")
    assert " True False []" in shown(to)
