"""Every registered query equals its check SQL, over whole tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from pagemill.plans import registry
from tests.oracle import connect, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert spark_rows(spark, name, SF) == oracle_rows(con, name)


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["book_id", "idx", "title", "url"]
    assert df.count() > 0


@pytest.mark.parametrize("kept", [[], ["corpus_pipeline.py"]])
def test_without_training_text(tmp_path, kept):
    """The tree without the training-text folders, with and without the pipeline that needs them."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *kept]:
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES)), "False"], said.stderr
