"""Every registered core query against its SQL, on the smallest tables."""

import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    said = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(said.fetchall(), columns)


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["tessera/llm"], ["tessera/llm", "corpus_pipeline.py"]])
def test_the_core_stands_without_the_training_data_operators(tmp_path, gone):
    home = pathlib.Path(entry.__file__).parent
    shutil.copytree(home / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (home / name).exists():
            shutil.copy(home / name, tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name) if (tmp_path / name).is_dir() else (tmp_path / name).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) == set(e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == sorted(registry.QUERIES)
