import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia import queries as engine

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([None if v != v else round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(engine.SQL | engine.STATED_SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    got = (engine.QUERIES | engine.STATED)[name](spark, sf)
    want = duck.sql((engine.SQL | engine.STATED_SQL)[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(engine.QUERIES) <= set(entry.queries()) and set(engine.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, left):
    for f in ROOT.rglob("*.py"):
        part = f.relative_to(ROOT)
        if "llm" in part.parts or part.name in {"corpus_pipeline.py"} - set(left) or part.parts[0].startswith("."):
            continue
        (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / part).write_text(f.read_text())
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
