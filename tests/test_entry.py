"""The driver's entry points."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "evergrove.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.queries()) == set(e.oracle_sql())
"""


def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.columns == ["user_id", "value", "ts"] and found.count() > 0


def test_checkpoints_are_cleaned(spark):
    assert spark.sparkContext.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"


def test_every_oracle_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_rest_works_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


GONE = """
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert len(e.queries()) > 100 and set(e.queries()) == set(e.oracle_sql())
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_works_with_the_folders_deleted(tmp_path, with_pipeline):
    """Both folders of the corpus operators gone, the pipeline's file there or not."""
    left = tmp_path / "repo"
    shutil.copytree(ROOT, left, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if with_pipeline else ["corpus_pipeline.py"])))
    assert not (left / "evergrove/llm").exists() and not (left / "tests/llm").exists() and (left / "corpus_pipeline.py").exists() == with_pipeline
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", GONE], cwd=left, env=environment, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=left, env=environment, check=True, timeout=120, stdout=subprocess.DEVNULL)
