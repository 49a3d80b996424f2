"""Delivered text of many queries against a loop that does one query after the other."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from impactgraph.operators import delivery


def clamp(line):
    size = len(line.encode())
    return line if size <= 1200 else line[:1200] + f"… [line truncated: {size} bytes]"


def merged(spans, n):
    raw = []
    for start, end, full in spans:
        end = max(start, end)
        if not full and end - start + 1 > 8:
            end = start + 7
        raw.append((max(1, start - 2), min(n, end + 2)))
    out = []
    for s, e in sorted(raw):
        if out and s <= out[-1][1] + 5:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    whole = n <= 80 or sum(e - s + 1 for s, e in out) >= 0.8 * n
    return ([[1, n]] if whole else out), whole


def section(path, content, spans, seen):
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    digest = hashlib.sha256(content.encode()).hexdigest()
    if (path, digest) in seen:
        return "pointer", f"[{path} unchanged, sha {digest[:8]}]\n"
    wins, whole = merged(spans, len(lines))
    dot = path.rsplit("/", 1)[-1].rsplit(".", 1)
    text, last = f"**`{path}`**\n\n```{dot[1] if len(dot) == 2 and dot[1].isalnum() else ''}\n", 0
    for s, e in wins:
        if last and s > last + 1:
            text += f"… [lines {last + 1}–{s - 1} omitted] …\n"
        text += "".join(f"{i}\t{clamp(lines[i - 1])}\n" for i in range(s, e + 1))
        last = e
    return ("whole" if whole else "windows"), text + "```\n\n"


def tokens(text):
    return max(1, len(text.encode()) // 4) if text else 0


def answer(picks, files, budget, most, head, seen):
    best, pos, spans = {}, {}, collections.defaultdict(list)
    for path, start, end, full, category, score, at in picks:
        if category != "test" and start > 0:
            best[path], pos[path] = max(best.get(path, 0), score), min(pos.get(path, at), at)
            spans[path].append((start, end, full))
    order = sorted(best, key=lambda p: (-best[p], pos[p], p))
    out, delivered, shown = {}, head, 0
    for i, path in enumerate(order):
        if path not in files:
            out[path] = (i + 1, "missing", 0, None)
            continue
        if shown >= most or (delivered > budget and i > 0):
            break
        state, text = section(path, files[path], spans[path], seen)
        cost = tokens(text)
        if delivered + cost > 2 * budget and shown:
            break
        room = 4 * max(200, 2 * budget - delivered)
        if delivered + cost > 2 * budget and len(text.encode()) > room:
            kept, size = [], 0
            for line in text.split("\n"):
                if size + len(line.encode()) + 1 > room:
                    break
                size += len(line.encode()) + 1
                kept.append(line + "\n")
            text, state = "".join(kept) + f"… [cut {path} here to stay within the budget; read the file for the rest]\n\n", "cut"
            cost = tokens(text)
        out[path] = (i + 1, state, cost, text)
        delivered, shown = delivered + cost, shown + 1
    for i, path in enumerate(order):
        out.setdefault(path, (i + 1, "missing" if path not in files else "listed", 0, None))
    return out


def test_deliveries(spark):
    r = random.Random(4)
    files = {f"d/{i}.{r.choice(['go', 'py', 'x-y'])}": "\n".join("x" * r.choice([0, 5, 40, 1500 if r.random() < 0.05 else 10]) + "é" * r.randint(0, 3) for _ in range(r.choice([1, 20, 81, 200, 900]))) + r.choice(["", "\n"]) for i in range(40)}
    files |= {"empty.py": "", "bare": "\n\n"}
    names = [*files, "gone.go", "gone2.go"]
    picks = collections.defaultdict(list)
    for q in range(25):
        for p in r.sample(names, r.randint(1, 12)):
            for _ in range(r.randint(1, 6)):
                s = r.randint(-1, 190)
                picks[f"q{q}"].append((p, max(0, s), s + r.randint(-2, 40), r.random() < 0.5, r.choice(["dependency", "target", "test"]), r.choice([0.1, 0.5, 0.9]), len(picks[f"q{q}"])))
    picks = {q: [p for p in own if not (p[0] in files and p[1] > max(1, files[p[0]].count("\n")))] for q, own in picks.items()}
    heads = {f"q{q}": r.choice([0, 10, 500, 3000]) for q in range(0, 25, 2)}
    seen = {(q, p) for q in picks for p in files if r.random() < 0.2}
    sha = lambda p: hashlib.sha256(files[p].encode()).hexdigest()
    picked = spark.createDataFrame([(q, *p) for q, own in picks.items() for p in own], "query string, file string, start int, end int, full boolean, category string, score double, pos long").repartition(4)
    table = spark.createDataFrame(list(files.items()), "file string, content string").withColumn("content", F.when(F.col("content") != "", F.col("content")))
    states = collections.Counter()
    for budget, most in ((300, 5), (2000, 3)):
        got = delivery.deliver(picked, table, budget, most, spark.createDataFrame(list(heads.items()), "query string, tokens int"), spark.createDataFrame([(q, p, sha(p)) for q, p in seen], "query string, file string, content_hash string"))
        found = collections.defaultdict(dict)
        for x in got.collect():
            found[x.query][x.file] = (x.rank, x.state, x.cost, x.text)
        for q, own in picks.items():
            want = answer(own, files, budget, most, heads.get(q, 0), {(p, sha(p)) for s, p in seen if s == q})
            assert found[q] == want, (q, {p: (found[q].get(p), w) for p, w in want.items() if found[q].get(p) != w})
            states.update(w[1] for w in want.values())
    assert set(states) == {"whole", "windows", "pointer", "cut", "listed", "missing"}


def test_no_window_without_partitions(spark):
    picked = spark.createDataFrame([("q", "a.go", 1, 2, True, "target", 1.0, 0)], "query string, file string, start int, end int, full boolean, category string, score double, pos long")
    got = delivery.deliver(picked, spark.createDataFrame([("a.go", "x\ny")], "file string, content string"), 100)
    assert got.first().text == "**`a.go`**\n\n```go\n1\tx\n2\ty\n```\n\n" and delivery.deliver(picked.limit(0), spark.createDataFrame([], "file string, content string"), 100).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
