"""The corpus operators on Spark against brute force, on small documents with nulls, ties, copies and long texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactgraph.llm import components, decontaminate, exact_dedup, language, line_dedup, mixture, ngram_join, substring_dedup, suffix_dedup, token_files, tokens
from impactgraph.llm.common import Scratch

from tests.llm.test_units import thue_morse

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_tokens string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(d, t, "en", "s0", 1, True, "x") for d, t in rows], SCHEMA).repartition(3)


def words(r, voc, n):
    return [r.choice(voc) for _ in range(n)]


def corpus(seed=5, n=90):
    r = random.Random(seed)
    voc = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(300)]
    base = words(r, voc, 400)
    rows = [(10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "é" * 300), (10_004, "é" * 299), (10_005, "one word"), (10_006, "one word")]
    for d in range(n):
        kind = r.random()
        if kind < 0.3:
            w = base[: r.randint(20, 400)]
        elif kind < 0.6:
            w = list(base)
            for _ in range(r.randint(0, 12)):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 2)] = [r.choice(voc)] * r.randint(0, 2)
            w = w[r.randint(0, 100) :]
        elif kind < 0.7:
            w = ["aa"] * r.randint(1, 300)
        elif kind < 0.8:
            w = (base[:7] + [f"q{d}"]) * r.randint(1, 30)
        else:
            w = words(r, voc, r.randint(0, 200))
        rows.append((d, (" " if d % 5 == 0 else "") + " ".join(w) + ("\n" if d % 7 == 0 else "")))
    return rows


EMPTY = []


def test_exact_dedup(spark):
    rows = corpus() + [(i + 500, "same\t text ") for i in range(40)] + [(499, "same text\n")]
    got = sorted(map(tuple, exact_dedup.classes(table(spark, rows)).collect()))
    groups = collections.defaultdict(list)
    norm = {d: exact_dedup.normalise((t or "").encode()) for d, t in rows}
    for d, t in norm.items():
        groups[t].append(d)
    assert got == sorted((d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t).hexdigest()) for d, t in norm.items())
    assert exact_dedup.classes(table(spark, EMPTY)).count() == 0
    kept = exact_dedup.dedup(table(spark, rows))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == len(groups)


def test_rows_of_one_id_go_by_their_texts(spark):
    rows = [(7, "a b"), (7, "a  b"), (8, "c"), (7, "other words"), (None, "a b"), (None, "d"), (None, "d"), (9, None), (10, ""), (None, None)]
    got = exact_dedup.dedup(table(spark, rows)).collect()
    assert sorted((exact_dedup.normalise((x.text or "").encode()), x.doc_id) for x in got if x.text != "d") == [(b"", 9), (b"a b", 7), (b"c", 8), (b"other words", 7)]
    assert [x.doc_id for x in got if x.text == "d"] == [None] and exact_dedup.dedup(table(spark, EMPTY)).count() == 0
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    got = ngram_join.keep_one(table(spark, [(3, t), (7, t), (7, u), (7, u), (None, u), (None, t + " x"), (None, ""), (4, None)])).collect()
    assert sorted(((x.doc_id or 0), x.text or "") for x in got) == [(0, ""), (0, t + " x"), (3, t), (4, ""), (7, u)]
    assert ngram_join.keep_one(table(spark, EMPTY)).count() == 0


def test_long_texts_are_hashed_by_chunks(spark, monkeypatch):
    r = random.Random(3)
    text = " \n".join(words(r, ["aa", "bbb", "é"], 60_000))
    rows = [(1, text), (2, text.replace("\n", "\t")), (3, text + "x"), (4, text[:-1] + "~"), (5, "short")]
    got = sorted(map(tuple, exact_dedup.classes(table(spark, rows)).collect()))
    sha = [hashlib.sha256(exact_dedup.normalise(t.encode())).hexdigest() for _, t in rows]
    assert got == [(1, 1, 2, True, sha[0]), (2, 1, 2, False, sha[1]), (3, 3, 1, True, sha[2]), (4, 4, 1, True, sha[3]), (5, 5, 1, True, sha[4])]
    prints = {x.doc_id: (x.n_bytes, x.fp) for x in exact_dedup._prints(table(spark, rows).select(F.col("doc_id").alias("row_key"), "doc_id", "text")).collect()}
    assert prints == {d: (f.length, f.word) for d, t in rows for f in [exact_dedup.fingerprint(exact_dedup.normalise(t.encode()))]}


def test_exact_dedup_separates_collisions(spark, monkeypatch):
    one = exact_dedup.Fingerprint(3, (1, 1))

    def rows(batches):  # every text has one fingerprint
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("doc_id"), pa.array([3] * n, pa.int64()), pa.array([one.word] * n, pa.int64()), pa.array([""] * n)], names=["row_key", "doc_id", "n_bytes", "fp", "text_sha256"])

    monkeypatch.setattr(exact_dedup, "_fingerprints", rows)
    got = exact_dedup.classes(table(spark, [(1, "abc"), (2, "xyz"), (3, "abc"), (4, "xyz"), (5, "qqq")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 2, 2, False), (5, 5, 1, True)]


def test_token_files(spark):
    path = P.path("word_bpe_49k.json")
    rows = corpus() + [(7, "again a 7"), (None, "no id")]
    got = token_files.encode_and_check(table(spark, rows), path).orderBy("start").collect()
    lib, total = tokens.tokenizer(path), 0
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[d].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    for r in got:
        assert r.start == total
        total += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]}
    assert token_files.encode_and_check(table(spark, EMPTY), path).count() == 0


def test_token_counts(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "CHUNK", 400)
    monkeypatch.setattr(tokens, "OVERLAP", 60)
    rows = corpus() + [(900, "word " * 2000), (901, "x" * 3000), (902, " " * 2500 + "é"), (903, "y" * 3000), (903, "y" * 3000), (None, "z " * 900)]
    got = sorted(map(tuple, tokens.counts(table(spark, rows), path).collect()), key=str)
    lib = tokens.tokenizer(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False))
    assert got == sorted(((d, len((t or "").encode()), n(t or ""), n(t or "") > 512) for d, t in rows), key=str)
    assert tokens.counts(table(spark, EMPTY), path).count() == 0


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) // line_dedup.EACH < 1 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


@pytest.mark.parametrize("block", [256, 20])
def test_line_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(2)
    voc = [f"a{i}" for i in range(50)]
    base = [words(r, voc, r.randint(1, 30)) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, "\n \n")]
    for d in range(120):
        lines = [""] * (r.random() < 0.2)
        for _ in range(r.randint(0, 8)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i = r.randrange(len(w)) if w else 0
                w[i : i + r.randint(0, 1)] = [r.choice(voc)] * r.randint(0, 1)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    seen, want = [], []
    for d, t in sorted(rows):
        out, lines = [], (t or "").split("\n")
        for line in lines:
            w = line.split(" ")
            if not line.strip() or not any(near(w, s) for s in seen):
                out.append(line)
            if line.strip():
                seen.append(w)
        want.append((d, None if t is None else "\n".join(out), 0 if t is None else len(lines), len(lines) - len(out)))
    got = line_dedup.dedup(table(spark, rows))
    assert sorted((r.doc_id, r.text, r.n_units, r.n_removed) for r in got.collect()) == want
    assert line_dedup.dedup(table(spark, EMPTY)).count() == 0


def removed_bytes(rows, k):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = collections.Counter(t[i : i + k] for _, t in texts for i in range(len(t) - k + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - k + 1):
            if times[t[i : i + k]] > 1:
                gone[i : i + k] = True
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


def removed_words(rows, k):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("local", [256, 3])
def test_suffix_and_substring_dedup(spark, monkeypatch, local):
    monkeypatch.setattr(suffix_dedup, "LOCAL", local)
    rows = corpus() + [(3, "repeated id " * 40), (3, "repeated id " * 40)] + [(5010 + i, t + " w" * 50 + f" {i}") for i, t in enumerate(thue_morse(1024))]
    df = table(spark, rows)
    assert sorted(map(tuple, suffix_dedup.removed(df).collect())) == removed_bytes(rows, 200)
    assert sorted(map(tuple, substring_dedup.removed(df).collect())) == removed_words(rows, 50)


def test_dedup_of_nothing(spark):
    for f in (suffix_dedup.removed, substring_dedup.removed, ngram_join.linked):
        assert f(table(spark, EMPTY)).count() == 0
        assert f(table(spark, [(1, None)])).count() == 1


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = dict(map(tuple, components.components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"), "t").collect()))
    assert got == {x: root(x) for ab in links for x in ab if any(x in p and p[0] != p[1] for p in links)}


def linked(rows, percent=85):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_join(spark):
    r = random.Random(1)
    voc = [f"w{i}" for i in range(400)]
    bases = [words(r, voc, r.randint(3, 120)) for _ in range(12)]
    rows = [(5000, None), (5001, ""), (5002, "A b"), (5003, "a B"), (5007, "words of one and of another row"), (5008, "Words of one and of another row"), *((5010 + i, t) for i, t in enumerate(thue_morse(1024)))]
    for d in range(260):
        w = list(r.choice(bases[: r.choice((4, 12))]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 2)] = [r.choice(voc)] * r.randint(0, 2)
        rows.append((d, " ".join(w)))
    df = table(spark, rows)
    want = linked(rows)
    assert sorted(map(tuple, ngram_join.linked(df, 4, 85).collect())) == want
    kept = ngram_join.keep_one(df, 4, 85)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _, c in want if c == d}


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([("a", item), ("b", "tiny item"), ("b", "tiny item"), ("c", None), (None, "zz zz")], "item_id string, text string")
    rows = [(1, "x " * 30 + item), (2, item.upper().replace(" ", ", ")), (3, "clean " * 50), (4, "y " * 100 + "tiny item"), (5, None), (6, "tiny item")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(table(spark, rows), bench).collect()}
    assert got == {1: (50, 20, 1, True), 2: (20, 20, 1, True), 3: (50, 0, 0, False), 4: (102, 2, 1, False), 5: (0, 0, 0, False), 6: (2, 2, 1, True)}
    df = table(spark, rows)
    kept = decontaminate.remove(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    cut = {r.doc_id: r.text for r in decontaminate.remove(df, bench, spans=True).collect()}
    assert cut[1].split() == ["x"] * 30 and cut[5] is None and cut[3] == "clean " * 50 and cut[6] == ""
    assert decontaminate.report(df, bench.limit(0)).where("n_hit > 0").isEmpty() and decontaminate.report(table(spark, EMPTY), bench).count() == 0


def test_language(spark):
    r = random.Random(1)
    vocab = {"aa": ["thing", "ought", "the", "with"], "bb": ["être", "queue", "ouais", "les"]}
    rows = [(d, " ".join(words(r, vocab[k], 20)), k) for d, k in enumerate(["aa", "bb"] * 100)] + [(900, "thing the", None), (901, None, "aa"), (902, "12 ...", "bb")]
    df = spark.createDataFrame([(d, t, k, "s", 1, True, "x") for d, t, k in rows], SCHEMA)
    rule = "pmod(crc32(cast(doc_id AS string)), 4) = 2"
    m = language.fit(df, where=f"NOT ({rule})")
    got = {x.doc_id: x for x in language.predict(df, m, rule).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert all(got[d].lang_pred == k for d, _, k in rows if d < 900) and got[900].lang_pred == "aa"
    assert [(got[d].lang_pred, got[d].score) for d in (901, 902)] == [("und", 0.0)] * 2
    kept = language.accepted(df, m)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(200)) | {900}
    none = language.fit(df.where("lang IS NULL"))
    assert {x.lang_pred for x in language.predict(df, none).collect()} == {"und"} and language.predict(table(spark, EMPTY), m).count() == 0


def fill(budget, capacity, weight):
    """Shares of a budget by weight that no capacity exceeds, by rounds."""
    out, open_ = {}, set(capacity)
    while open_:
        w = sum(weight[k] for k in open_)
        full = [k for k in open_ if budget * weight[k] / w >= capacity[k] - 1e-9]
        if not full:
            out |= {k: budget * weight[k] / w for k in open_}
            break
        for k in full:
            out[k] = capacity[k]
        budget -= sum(capacity[k] for k in full)
        open_ -= set(full)
    return out


def test_budgets(spark):
    leaves = [("web", "en", "s0", 500), ("web", "en", "s1", 20), ("web", "de", "s0", 300), ("books", "en", "s3", 1000), ("other", "", "", 40), ("other", "fr", "x", 0)]
    w = {"__domain": {"web": 6, "books": 3}, "__lang": {"en": 4}, "__source": {}}
    got = mixture.budgets(spark.createDataFrame(leaves, "__domain string, __lang string, __source string, tokens long"), 0.5, 2, w)
    top = fill(930, {"web": 1640, "books": 2000, "other": 80}, {"web": 6, "books": 3, "other": 1})
    web = fill(top["web"], {"en": 1040, "de": 600}, {"en": 4, "de": 1})
    en = fill(web["en"], {"s0": 1000, "s1": 40}, {"s0": 1, "s1": 1})
    want = {("web", "en", "s0"): en["s0"], ("web", "en", "s1"): en["s1"], ("web", "de", "s0"): web["de"], ("books", "en", "s3"): top["books"], ("other", "", ""): top["other"]}
    assert {tuple(r)[:3]: r.budget for r in got.collect()} == {k: int(v + 1e-9) for k, v in want.items()}


def test_mixture(spark):
    r = random.Random(3)
    rows = [(d, None if d % 50 == 0 else "w" * r.randint(0, 400), r.choice(["en", "de", None]), r.choice(["src0", "src4", "src9", None])) for d in range(400)]
    df = spark.createDataFrame([(d, t, k, s, 1, True, "x") for d, t, k, s in rows], SCHEMA).repartition(3)
    got = {x.doc.doc_id: x for x in mixture.copies(df, share=0.7).collect()}
    plan = {tuple(x)[:3]: (x.tokens, x.budget) for x in mixture.budgets(mixture.copies(df, share=0.7).groupBy(*mixture.LEVELS).agg(F.sum("__tokens").alias("tokens")), 0.7, 2, mixture.WEIGHTS).collect()}
    by_leaf = collections.defaultdict(list)
    for x in got.values():
        by_leaf[x["__domain"], x["__lang"], x["__source"]].append(x)
    for leaf, xs in by_leaf.items():
        total, budget = plan[leaf]
        full, rest = divmod(budget, total)
        used = 0
        key = lambda x, full=full: hashlib.md5(f"11:{full}:{x.doc.doc_id}".encode()).hexdigest()[:15]
        for x in sorted(xs, key=lambda x: (key(x), x.doc.doc_id)):
            used += x["__tokens"]
            assert x["__copies"] == full + (used <= rest)
    out = mixture.mixed(df, share=0.7)
    assert out.columns == df.columns and out.count() == sum(x["__copies"] for x in got.values())
    odd = df.withColumns({"__domain": F.lit("d"), "__tokens": F.lit("t"), "doc": F.lit(1), "row_key": F.lit(2), "copy": F.lit(3)})
    same = mixture.mixed(odd, share=0.7)
    assert same.columns == odd.columns and sorted(x.doc_id for x in same.collect()) == sorted(x.doc_id for x in out.collect())
    assert mixture.copies(table(spark, EMPTY)).count() == 0 and mixture.mixed(table(spark, EMPTY)).columns == df.columns and {x["__copies"] for x in mixture.copies(df, share=0.0).collect()} <= {0, 1}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    vocab = {"en": ["thing", "ought", "the", "with", "reading"], "fr": ["être", "queue", "ouais", "les", "mentre"]}
    item = " ".join(words(r, vocab["en"], 20))
    rows = [(d, " ".join(words(r, vocab[k], r.randint(20, 60))), k, f"src{d % 4}") for d, k in enumerate(["en", "fr"] * 40)]
    rows += [(200, rows[0][1], "en", "src0"), (201, None, "en", "src1"), (202, item, "en", None), (203, "123", None, "src1")]
    spark.createDataFrame([(d, t, k, s, 1) for d, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: sorted(x.doc_id for x in df.collect())
    a = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert a.columns == docs.columns and ids(a) == [*range(80), 200, 202]
    b = corpus_pipeline.near_duplicates_stage(spark, a, str(tmp_path))
    assert b.columns == docs.columns and ids(b) == [*range(80), 202]
    c = corpus_pipeline.benchmark_stage(spark, b, str(tmp_path))
    assert c.columns == docs.columns and ids(c) == [*range(80)]
    d = corpus_pipeline.mixing_stage(spark, c, str(tmp_path))
    assert d.columns == docs.columns and set(ids(d)) <= set(range(80))
    last = corpus_pipeline.tokens_stage(spark, d, str(tmp_path))
    assert ids(last) == ids(d) and len(corpus_pipeline.STAGES) == 5
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(d)
