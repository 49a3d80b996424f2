"""The index after any series of batches against one built from the last state."""

import collections
import random

import pytest

from impactgraph.operators.incremental import EDGES, FILES, SYMBOLS, GraphIndex


def rebuilt(state):
    comp = {}
    for file, (_, symbols, _) in state.items():
        for s in symbols:
            if s[2] != "document" and "_test." not in file:
                comp.setdefault(s[1], []).append(file.rsplit("/", 1)[0])
    out = collections.Counter()
    for _, _, edges in state.values():
        for _, src, dst, kind in edges:
            if kind in ("calls", "imports"):
                for a in comp.get(src, []):
                    for b in comp.get(dst, []):
                        if a != b:
                            out[a, b, kind] += 1
    return dict(out)


def test_a_series_of_batches_is_a_rebuild(spark, tmp_path):
    r = random.Random(6)
    names = [f"d{i % 4}/f{i}{'_test' if i % 9 == 0 else ''}.go" for i in range(20)]
    ids = [f"s{i}" for i in range(40)]  # some in several files, some in none
    index, state = GraphIndex(spark, str(tmp_path / "index"), buckets=4), {}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for batch in (0, 1, 2, 5):
        files, symbols, edges, want = [], [], [], collections.Counter()
        for f in r.sample(names, [20, 6, 0, 9][min(batch, 3)]):
            if r.random() < 0.25:
                files.append((f, None))
                want["files_pruned"] += f in state
                state.pop(f, None)
                continue
            sha = state[f][0] if f in state and r.random() < 0.3 else str(r.random())
            files.append((f, sha))
            same = f in state and state[f][0] == sha
            want["files_skipped" if same else "files_updated"] += 1
            own = [(f, r.choice(ids), r.choice(["function", "function", "document"]), "n") for _ in range(r.randint(0, 6))]
            calls = [(f, r.choice(ids), r.choice(ids), r.choice(["calls", "imports", "contains"])) for _ in range(r.randint(0, 8))]
            symbols += own
            edges += calls
            if not same:
                state[f] = (sha, own, calls)
        args = frame(files + [(None, "x")], FILES), frame(symbols + [("other.go", "s1", "function", "n")], SYMBOLS), frame(edges, EDGES)
        counts = index.apply(batch, *args)
        assert {k: counts[k] for k in ("files_updated", "files_skipped", "files_pruned")} == {k: want[k] for k in ("files_updated", "files_skipped", "files_pruned")}
        assert index.apply(batch, *args) == counts  # sent again
        assert {(x.src_comp, x.dst_comp, x.type): x.weight for x in index.induced().collect()} == rebuilt(state)
        assert {tuple(x) for x in index.files().collect()} == {(f, v[0]) for f, v in state.items()}
        assert collections.Counter(map(tuple, index.symbols().collect())) == collections.Counter(x for v in state.values() for x in v[1])
        assert collections.Counter(map(tuple, index.edges().collect())) == collections.Counter(x for v in state.values() for x in v[2])
    assert index.batches() == [0, 1, 2, 5] and len(state) > 5
    with pytest.raises(ValueError):
        index.apply(3, *args)
    index.vacuum()
    assert {(x.src_comp, x.dst_comp, x.type): x.weight for x in index.induced().collect()} == rebuilt(state) and index.files().count() == len(state)


def test_a_batch_that_failed_half_way_is_written_over(spark, tmp_path, monkeypatch):
    index = GraphIndex(spark, str(tmp_path / "index"), buckets=2)
    args = spark.createDataFrame([("a/x.go", "1"), ("b/y.go", "1")], FILES), spark.createDataFrame([("a/x.go", "p", "function", "p"), ("b/y.go", "q", "function", "q")], SYMBOLS), spark.createDataFrame([("a/x.go", "p", "q", "calls")], EDGES)
    with monkeypatch.context() as m:
        m.setattr(GraphIndex, "_delta", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.apply(0, *args)
    assert index.batches() == [] and index.induced().isEmpty() and index.symbols().isEmpty()
    index.apply(0, *args)
    assert [tuple(x) for x in index.induced().collect()] == [("a", "b", "calls", 1)]


def test_a_stream_of_changes(spark, tmp_path):
    index = GraphIndex(spark, str(tmp_path / "index"), buckets=2)
    for i, sha in enumerate(("1", "2")):
        spark.createDataFrame([("a/x.go", sha), ("b/y.go", sha)], FILES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))

    def parse(rows):
        rows = rows.select("file", "sha")
        symbols = rows.selectExpr("file", "concat(file, '#', sha) AS id", "'function' AS kind", "'n' AS name")
        edges = rows.where("file = 'a/x.go'").selectExpr("file", "concat(file, '#', sha) AS src", "concat('b/y.go#', sha) AS dst", "'calls' AS type")
        return rows, symbols, edges

    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = index.follow(stream, parse).option("checkpointLocation", str(tmp_path / "point")).start()
    query.processAllAvailable()
    query.stop()
    assert index.batches() == [0, 1] and [tuple(x) for x in index.induced().collect()] == [("a", "b", "calls", 1)]
    assert {x.sha for x in index.files().collect()} == {"2"}


def test_a_batch_runs_its_own_plan_once(spark, tmp_path):
    """Rows of a batch are read from what it wrote, however costly their plan is."""
    from pyspark.sql import functions as F

    ran = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        ran.add(1)
        return x

    files = spark.createDataFrame([("a/f.go", "1"), ("b/g.go", "1")], FILES)
    symbols = spark.createDataFrame([("a/f.go", "x", "function", "x"), ("b/g.go", "y", "function", "y")], SYMBOLS)
    edges = spark.createDataFrame([("a/f.go", "x", "y", "calls")] * 3, EDGES).withColumn("dst", counted("dst"))
    index = GraphIndex(spark, str(tmp_path / "once"), buckets=4)
    index.apply(0, files, symbols, edges)
    assert ran.value == 3
    assert [tuple(x) for x in index.induced().collect()] == [("a", "b", "calls", 3)]
