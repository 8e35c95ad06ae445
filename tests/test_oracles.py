"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run with the same columns and rows twice."""

import math
import os

import duckdb
import pytest

from larkspan.plans import registry

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.5g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    duck.execute(registry.ORACLES[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(names, duck.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"gaussian_mixture", "pca_kmeans"}))
def test_query_without_sql_is_stable(spark, name):
    df = registry.QUERIES[name](spark, SF)
    first = _rows(df.columns, [tuple(r) for r in df.collect()])
    again = registry.QUERIES[name](spark, SF)
    assert first == _rows(again.columns, [tuple(r) for r in again.collect()])


def test_entry_imports_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in ("__spark_entry__.py", "larkspan"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if (root / p).is_dir() else {}))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
