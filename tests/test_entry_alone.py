"""The entry module lists its other queries where the training-data operators are absent."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LISTED = """
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 100 and set(entry.oracle_sql()) <= names
assert "pipeline" not in names and not any(n.startswith("op") for n in names)
"""


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "loomledger", tmp_path / "loomledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
