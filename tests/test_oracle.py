"""Engine queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from gridstone import queries as q

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v != v else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data")
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    ours, theirs = q.QUERIES[name](spark, DATA).toPandas(), con.execute(q.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridstone", tmp_path / "gridstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'count_gt' in e.queries(); assert not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
