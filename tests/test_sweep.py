"""Touched rows against a loop over all ranges, over many blocks of lines, and their growth on one large file."""

import random

import pytest
from pyspark.sql import functions as F

from impactgraph.operators import sweep, verify


@pytest.mark.parametrize("lines", [8, 1 << 14])
def test_touched(spark, monkeypatch, lines):
    monkeypatch.setattr(sweep, "LINES", lines)
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b", None]), i, (s := r.randint(1, 300)), r.choice([s, s + r.randint(0, 40)]), r.choice(["x", None])) for i in range(400)] + [("a", 400, None, 5, "x"), ("a", 401, 3, None, None)]
    ranges = [(r.choice(["a", "b", "c", None]), (s := r.randint(0, 300)), s + r.choice([0, 0, 3, 20, -2])) for _ in range(60)]
    df = spark.createDataFrame(rows, "file string, start long, lo int, hi int, touched_by string").repartition(3)
    got = sweep.touched(df, "lo", "hi", spark.createDataFrame(ranges, "file string, start int, end int")).collect()
    want = {x[1]: x[0] is not None and None not in x[2:4] and any(f == x[0] and s <= e and s <= x[3] and e >= x[2] for f, s, e in ranges) for x in rows}
    assert {x.start: x.touched for x in got} == want and len(got) == len(rows) and sum(want.values()) > 50
    assert sorted(map(str, (tuple(x)[:-1] for x in got))) == sorted(map(str, rows))
    none = spark.createDataFrame([], "file string, start int, end int")
    assert sweep.touched(df, "lo", "hi", none).where("touched").isEmpty() and sweep.touched(df.limit(0), "lo", "hi", none).isEmpty()


def test_one_file_of_a_million_lines(spark):
    """All lines of one file as rows, a tenth of them a changed range: no product of rows and ranges is made."""
    rows = spark.range(1, 1_000_001).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    changed = spark.range(1, 100_001).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("start"), (F.col("id") * 10).alias("end"))
    got = sweep.touched(rows, "line", "line", changed)
    assert got.where("touched").agg(F.count("*"), F.sum("line")).first()[:] == (100_000, 10 * 100_000 * 100_001 // 2)
    spans = spark.range(0, 200_000).select(F.lit("f").alias("file"), (F.col("id") * 5 + 1).alias("start"), (F.col("id") * 5 + 4).alias("end"))
    assert verify.touched_spans(spans, changed).isEmpty()
