"""The evicting tracker: reuse distances over many blocks, strategies against a simulated tracker, stream equal to batch."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactgraph.operators import reuse, scan
from impactgraph.streaming import sessions
from tests.test_streaming import drain

SCHEMA = "session long, file string, content_hash long, seq long, tokens long"


def log(seed=1, n=1500):
    r = random.Random(seed)
    # One session has most reads, one a single file, one many files, one an odd name.
    rows = []
    for i in range(n):
        s = r.choice([1] * 6 + [2, 3, 4])
        file = {1: f"f{int(r.expovariate(0.15))}", 2: "only", 3: f"g{r.randrange(400)}", 4: f"h{i % 7}"}[s]
        rows.append((s, file, r.randrange(3) if r.random() < 0.3 else 0, i, r.randrange(100)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq") / 3)).repartition(4)


def simulated(rows, capacity, window):
    """A tracker by its rules: a list of files, the last read at the end."""
    out, trackers, sent = {}, collections.defaultdict(list), collections.Counter()
    for s, file, content, seq, tokens in sorted(rows, key=lambda x: x[3]):
        known = trackers[s]
        entry = next((e for e in known if e[0] == file), None)
        count, same, previous = (entry[2], entry[1] == content, entry[3]) if entry else (0, False, 0)
        ratio = (sent[s] - previous) / window
        sure = "high" if ratio < 0.3 else "medium" if ratio < 0.7 else "low"
        if count == 0 or not same:
            strategy = "full-fresh"
        elif count >= 3:
            strategy = "sha-pointer" if sure == "high" else "escalated-full"
        elif count == 2:
            strategy = {"high": "sha-pointer", "medium": "session-signature", "low": "full-fresh"}[sure]
        else:
            strategy = "sha-pointer"
        out[seq] = (s, file, count, same, strategy)
        known[:] = [e for e in known if e[0] != file] + [(file, content, count + 1, tokens)]
        del known[:-capacity]
        sent[s] += tokens
    return out


def test_dominance_counts():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 64, 300):
        v, x = r.integers(-5, 20, n), r.integers(-5, 20, n)
        assert reuse.later_at_least(v, x).tolist() == [int((v[i + 1 :] >= x[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_distances_over_blocks(spark, size):
    rows = log()
    last, order, want = {}, collections.defaultdict(list), {}
    for s, file, _, seq, _ in rows:
        at = last.get((s, file))
        want[seq] = None if at is None else len(set(order[s][at + 1 :]))
        last[s, file] = len(order[s])
        order[s].append(file)
    got = reuse.distances(table(spark, rows), size).collect()
    assert {x.seq: x.distance for x in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("capacity", [1, 3, 20, 50_000])
def test_strategies_of_a_tracker(spark, capacity):
    rows = log(3, 900)
    got = reuse.strategies(table(spark, rows), 2000, capacity).collect()
    assert {x.seq: (x.session, x.file, x["count"], x.same, x.strategy) for x in got} == simulated(rows, capacity, 2000)
    assert reuse.strategies(table(spark, []), 2000, capacity).isEmpty()


def test_null_sessions_and_files(spark):
    rows = [(None, None, 1, 0, 5), (None, "a", 1, 1, 5), (None, None, 1, 2, 5), (1, None, 1, 3, 5), (1, None, 1, 4, 5)]
    got = {x.seq: (x.distance, x["count"]) for x in reuse.accesses(table(spark, rows), 2).collect()}
    assert got == {0: (None, 0), 1: (None, 0), 2: (1, 1), 3: (None, 0), 4: (0, 1)}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_stream_is_batch(spark, rocks, tmp_path):
    rows = log(5, 240)
    for i in range(3):  # three batches
        table(spark, rows[80 * i : 80 * i + 80]).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(spark, sessions.evicting_strategies(stream, 2000, 3), "evicting", "append")
    assert {x.seq: (x.session, x.file, x["count"], x.same, x.strategy) for x in got.collect()} == simulated(rows, 3, 2000)


def test_prefix_sums_of_a_group_over_many_blocks(spark):
    r = random.Random(7)
    rows = [(r.choice(["a"] * 8 + ["b", None]), i, r.choice([None, 1, 5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(8)
    got = scan.prefix(df, ["k"], ["i"], {"before": F.col("v")}).collect()
    at, total = collections.Counter(), collections.Counter()
    want = {}
    for k, i, v in rows:
        want[i] = (at[k], total[k])
        at[k] += 1
        total[k] += v or 0
    assert {x.i: (x.pos, x.before) for x in got} == want
    assert {x.i: x.pos for x in scan.prefix(df.where("k = 'a'"), ["k"], [F.desc("i")]).collect()} == {i: n for n, i in enumerate(sorted((i for k, i, _ in rows if k == "a"), reverse=True))}
    assert scan.prefix(df.limit(0), ["k"], ["i"]).isEmpty()
