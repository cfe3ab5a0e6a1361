"""Each query with SQL must give what DuckDB gives; the others must give rows of a stable schema."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry
from arborlake.plans.queries import ORACLES, QUERIES

from .conftest import SF

SLOW = {"structural_groups", "stem_detection", "species_model", "terrain_model", "tree_feature_table"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].round(5) if df[c].dtype.kind == "f" else df[c].map(lambda v: "null" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    numeric = [c for c in ours if ours[c].dtype.kind == "f" or theirs[c].dtype.kind == "f"]
    for c in numeric:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    pd.testing.assert_frame_equal(_plain(ours), _plain(theirs), check_dtype=False, atol=2e-5)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["tree_id", "n_points", "height_m", "height_max_m"]
    assert df.count() == 10


def test_registry_agrees():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """In a copy without the text folders the registry imports and holds the other queries."""
    root = Path(registry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "corpus_pipeline.py", tmp_path) if (root / "corpus_pipeline.py").exists() else None
    shutil.copytree(root / "arborlake", tmp_path / "arborlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(sorted(q)); assert set(s) <= set(q)"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert eval(found.stdout) == sorted(QUERIES)
