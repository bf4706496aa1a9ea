"""The driver's contract, with and without the training-data folder."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "lww_snapshot" in queries


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12


def test_without_the_training_data_folder(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()); assert not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": ""})
