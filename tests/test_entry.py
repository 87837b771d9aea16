"""The entry point without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def copied(to, *without):
    skipped = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[Path(w).name for w in without])
    shutil.copytree(ROOT, to, ignore=skipped)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op1_') for q in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=True).stdout.split()


def test_import_without_the_subpackage_and_the_pipeline(tmp_path):
    """Both gone, or only one of them."""
    count, pipeline, training = copied(tmp_path / "bare", "llm", "corpus_pipeline.py")
    assert int(count) > 150 and (pipeline, training) == ("False", "False")
    assert copied(tmp_path / "left", "llm")[1:] == ["False", "False"]
