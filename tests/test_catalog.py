"""Every query of the catalog against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from twinloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df):
    names = sorted(df.columns)
    return sorted(tuple("" if x is None or x != x else str(x) for x in row) for row in df[names].astype(object).itertuples(index=False, name=None)), names


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_operators(tmp_path):
    """The entry module and the rest of the package do without the subpackage and the pipeline, and hide no other failure."""
    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "twinloom", tmp_path / "twinloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run().returncode == 0, run().stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
