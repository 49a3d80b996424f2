"""Benchmark items without an id against the query's SQL."""

import pytest

from impactgraph.llm import decontaminate, queries
from tests.llm.test_operators import table


def test_passages_of_items_without_an_id_are_hit(spark):
    duckdb = pytest.importorskip("duckdb")
    one, two = (" ".join(f"{x}{i}" for i in range(20)) for x in "tu")
    items = [(None, one), (None, "zz zz"), ("b", two), (None, None)]
    rows = [(1, one), (2, f"{one} {two} zz zz"), (3, two), (4, "clean " * 30)]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), table(spark, rows)
    got = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    con = duckdb.connect()
    for name, held, id_ in (("benchmark", items, "item_id VARCHAR"), ("documents", rows, "doc_id BIGINT")):
        con.execute(f"CREATE TABLE {name} ({id_}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", held)
    assert got == sorted(con.execute(queries.ORACLES["op10_decontaminate"]).fetchall())
    assert [(d, hit, bad) for d, _, hit, _, _, bad in got] == [(1, 20, True), (2, 42, True), (3, 20, True), (4, 0, False)]
    assert [x.doc_id for x in decontaminate.remove(docs, bench).collect()] == [4]
