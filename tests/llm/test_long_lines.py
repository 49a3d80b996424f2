"""Line deduplication of whole long lines on Spark against brute force."""

import random

from impactgraph.llm import line_dedup
from tests.llm.test_operators import near, table, words


def test_long_lines_are_judged_whole(spark):
    r = random.Random(6)
    voc = [f"a{i}" for i in range(50)]
    rows, d = [], 0
    for n in (254, 255, 256, 257, 258, 511, 512, 513, 600, 1500):
        base = words(r, voc, n)
        for at in (None, 0, 10, n // 2, n - 1):
            for swap in ([], ["x"], ["x", "y"]):  # of one word: deleted, replaced, two for one
                w = list(base)
                if at is not None:
                    w[at : at + 1] = [*swap, base[at]] if len(swap) == 2 and r.random() < 0.3 else [f"{x}{r.randint(0, 2)}" for x in swap]
                rows.append((d, " ".join(w) + ("\nshort" if d % 4 == 0 else "")))
                d += 1
        half = base[: n // 2]
        rows.append((d, " ".join(half + words(r, voc, n - n // 2))))
        d += 1
    rows = [(i, t) for i, (_, t) in zip(r.sample(range(len(rows)), len(rows)), rows, strict=True)] + [(5000, rows[0][1]), (5001, "b " * 600)]
    seen, want = [], []
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            w = line.split(" ")
            if not any(near(w, s) for s in seen):
                keep.append(line)
            seen.append(w)
        want.append((i, "\n".join(keep), t.count("\n") + 1 - len(keep)))
    got = line_dedup.dedup(table(spark, rows))
    assert sorted((x.doc_id, x.text, x.n_removed) for x in got.collect()) == want


def test_the_query_finds_a_word_inserted_early_in_a_long_line(spark, tmp_path):
    from impactgraph.llm import queries

    line = [f"w{i}" for i in range(600)]
    part = line[:256] + [f"v{i}" for i in range(300)]
    table(spark, [(1, " ".join(line)), (2, " ".join([*line[:10], "new", *line[10:]])), (3, " ".join(part))]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.n_units, x.n_removed) for x in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 0)}
