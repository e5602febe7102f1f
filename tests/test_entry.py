import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_stands_without_the_subpackage(tmp_path, pipeline_too):
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", *(["corpus_pipeline.py"] if pipeline_too else []))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'e_feature_layer' in names and 'pipeline' not in names; assert set(e.oracle_sql()) <= names and not [n for n in names if n.startswith('op')]; import bench"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
