"""Every registered query of the graph and text operators against DuckDB, and the entry module without the corpus part."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from impactgraph.plans import catalog, contracts, diffs, increments, indexed, rules, seeds, sessions  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return float(f"{v:.9g}") if isinstance(v, (float, int)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(rows) == key([tuple(r[c] for c in got.columns) for r in want])


def test_entry_without_the_corpus_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['impactgraph.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(set(e.queries())) and 'induced_edges' in e.queries() and not any(x.startswith('op') or x == 'pipeline' for x in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}).returncode == 0
