"""Reverse patching against the real texts, over diffs made with and without context."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from impactgraph.operators import verify
from impactgraph.sources import patches


def unified(old_name, new_name, old, new, context):
    """A diff as the usual tools print it, with marks of missing line breaks."""
    out = []
    for i, line in enumerate(difflib.unified_diff(old.splitlines(True) if old else [], new.splitlines(True) if new else [], old_name, new_name, n=context)):
        out.append(line.rstrip("\n"))
        if i > 1 and not line.endswith("\n") and line[:1] in "+- ":
            out.append("\\ No newline at end of file")
    return out


def texts(seed):
    """(old path, new path, old, new): lines that look like headers among them."""
    r = random.Random(seed)
    voc = ["a", "b", "", "-- x", "++ y", "--- a/no", "+++ b/no", "@@ -1 +1 @@", "\\ No newline", " z", "-", "+", "é", "tab\tend", "cr\r"]
    out = []
    for i in range(40):
        old = [r.choice(voc) for _ in range(r.choice([0, 1, 2, 10, 60]))]
        new = list(old)
        for _ in range(r.randint(1, 8)):
            at = r.randint(0, len(new))
            new[at : at + r.randint(0, 3)] = [r.choice(voc) for _ in range(r.randint(0, 3))]
        join = lambda lines: "\n".join(lines) + (r.choice(["\n", ""]) if lines and lines[-1] else "\n" if lines else "")
        a, b = join(old), join(new)
        if a == b:
            continue
        kind = r.random()
        if kind < 0.15 and a:
            out.append((f"src/d{i}.go", None, a, ""))
        elif kind < 0.3 and b:
            out.append((None, f"src/n{i}.go", "", b))
        elif kind < 0.5:
            out.append((f"src/old{i}.go", f"src/new{i}.go", a, b))
        elif a or b:
            out.append((f"src/f{i}.go", f"src/f{i}.go", a, b))
    return out


def parsed(spark, changes, context):
    rows = []
    for name, own in changes.items():
        lines = []
        for old, new, a, b in own:
            lines += ["diff --git x y", "index 1..2 100644"] + unified(f"a/{old}\t2024" if old else "/dev/null", f"b/{new}" if new else "/dev/null", a, b, context)
        rows += [(name, i, t) for i, t in enumerate(lines)]
    return patches.hunks(spark.createDataFrame(rows, "change string, n long, text string").repartition(5), "src/")


@pytest.mark.parametrize("context", [0, 3])
def test_base_content(spark, context):
    changes = {f"c{i}": texts(10 * i + context) for i in range(4)} | {None: texts(99)[:3]}
    hunks, body = parsed(spark, changes, context)
    short = lambda p: p.removeprefix("src/") if p else p
    for name, own in changes.items():
        same = F.col("change").eqNullSafe(F.lit(name))
        after = spark.createDataFrame([(short(new), b) for _, new, _, b in own if new], "file string, content string")
        got = {x.file: x.content for x in patches.base_content(hunks.where(same), body.where(same), after).collect()}
        want = {short(old): a for old, _, a, _ in own if old}
        assert got == want, (name, {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v})
        states = {(x.file, x.old_file): x.state for x in patches.changed_files(hunks.where(same)).collect()}
        assert states == {(short(new or old), short(old)): "deleted" if not new else "added" if not old else "changed" if old == new else "renamed" for old, new, _, _ in own}
    assert hunks.count() > 100


def test_ranges_of_the_after_side(spark):
    text = "--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n-p\n-q\n+a\n+b\n+c\n+d\n@@ -9 +12 @@\n-r\n+s\n@@ -20,3 +19,0 @@\n-t\n-u\n-v\n--- a/y.go\n+++ /dev/null\n@@ -1 +0,0 @@\n-w\n--- a/z.go\n+++ b/z.go\n@@ -1 +0,0 @@\n-w"
    hunks, body = patches.hunks(spark.createDataFrame([("c", i, t) for i, t in enumerate(text.split("\n"))], "change string, n int, text string"))
    assert sorted(map(tuple, patches.changed_ranges(hunks).collect())) == [("c", "x.go", 3, 6), ("c", "x.go", 12, 12), ("c", "x.go", 19, 19), ("c", "z.go", 1, 1)]
    assert body.count() == 13
    none = spark.createDataFrame([], "change string, n int, text string")
    assert all(d.isEmpty() for d in patches.hunks(none)) and patches.base_content(*patches.hunks(none), spark.createDataFrame([], "file string, content string")).isEmpty()


def test_seeds_of_deleted_files_and_blocks(spark):
    base = spark.createDataFrame([("f", "function", "a.go"), ("K", "const", "a.go"), ("t", "function", "a_test.go"), ("kept", "function", "b.go")], "name string, kind string, file string")
    files = spark.createDataFrame([("a.go", "deleted"), ("a_test.go", "deleted"), ("b.go", "changed"), ("img.png", "deleted")], "file string, state string")
    assert sorted(map(tuple, verify.removed_with_file(base, files).collect())) == [("K", "a.go", "removed with file", "unverified"), ("f", "a.go", "removed with file", "seed"), ("img.png", "img.png", "removed with file", "unverified")]
    lines = lambda text: spark.createDataFrame([("d.ts", i + 1, t) for i, t in enumerate(text.split("\n"))], "file string, line int, text string")
    before, after = lines("interface D {\n  run(a: int,  b: str): void\n  // run(x)\n  stop(): void\n  keep(a: int): void\n}\ninterface E {\n x: int\n}"), lines("interface D {\n  keep(a: int): str\n  run(a: int): void\n  stop(now: bool): void\n  fresh(a: int)\n}\ninterface E {\n x: str\n}")
    blocks = spark.createDataFrame([("d.ts", "D", 1, 6, 1, 6), ("d.ts", "E", 7, 9, 7, 9)], "file string, block string, start0 int, end0 int, start1 int, end1 int")
    assert sorted(map(tuple, verify.block_seeds(before, after, blocks).collect())) == [("E", "d.ts", "E", "block", "unverified", "", ""), ("run", "d.ts", "D", "member", "seed", "a: int, b: str", "a: int")]


def test_only_whole_changes_are_dealt_by_samples(spark, monkeypatch):
    """Hunks and files are dealt by their places: a sample runs the plan before it once more."""
    from pyspark.sql.classic.dataframe import DataFrame

    calls, real = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *a: (calls.append(a), real(self, *a))[1])
    diff = spark.createDataFrame([("c", i, t) for i, t in enumerate(["--- a/f", "+++ b/f", "@@ -1 +1 @@", "-x", "+y"])], "change string, n int, text string")
    after = spark.createDataFrame([("f", "y\nz\n")], "file string, content string")
    got = patches.base_content(*patches.hunks(diff), after).collect()
    assert [tuple(x) for x in got] == [("c", "f", "x\nz\n")]
    assert len(calls) == 2
