"""The driver entry: names, columns, SQL twins on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from evplace.plans import registry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("evplace/llm", "tests/llm"), ("evplace/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_training_data_folders(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    there = tmp_path / "repo"
    shutil.copytree(root, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(there / name) if (there / name).is_dir() else (there / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op3_') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=there, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, near = out.stdout.split()
    assert int(n) >= len(registry.QUERIES) and pipeline == "False" and near == str("evplace/llm" not in gone and os.path.isdir(f"{root}/evplace/llm"))


def test_other_import_errors_are_errors(tmp_path, monkeypatch):
    (tmp_path / "broken_here.py").write_text("import no_such_module_at_all")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._present("broken_here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted((tuple(None if pd.isna(x) else round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"compare_recall"}))
def test_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
