"""The driver's entry points, with and without the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """A copy without the folders of the training-data part lists its queries, whether or not the pipeline's file is there."""
    ignored = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", "*.txt")
    for part in ("nearby", "tools"):
        shutil.copytree(f"{ROOT}/{part}", tmp_path / part, ignore=ignored)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for pipeline in (False, True):
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("from nearby.llm import bpe")
        subprocess.run([sys.executable, "-c", told], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
