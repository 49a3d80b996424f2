"""The trigram index against scans: the same rows for every term, and only the pages of its trigrams read."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactgraph.operators import lookup, search, text
from impactgraph.sources.adapters import split_lines

TEXTS = [
    ("a.go", "func Load(path string) error {\n\treturn open(path)\n}\n// the İstanbul ΣΑΣ case\n" + "x\n" * 70 + "needle at 75\n"), ("b.py", "def load(p):\n    # Load it\n    return 'need' + 'le'\n"), ("c.txt", ""), ("d.txt", None), ("e.txt", "ab"),
    ("f.txt", "one long line " * 3000 + "Needle" + " more" * 3000), ("g.txt", "\n\n\nneedle\r\n\n"), ("g.txt", "a second file of one name, needle"), ("h.txt", "colour color colours\nthe KELVIN sign K\n100% sure (really) [x] a+b a.b"), ("i.txt", "ſharp needles 😀😀😀 end"),
]
LITERALS = ["needle", "Needle", "load", "ne", "x", "", "the", "ΣΑΣ", "σας", "İstanbul", "kelvin", "K sign", "😀😀😀", "(really)", "a+b", "absent words", "one long line one", "more more", "le\r", "ſharp", "a\nb", "100%"]
REGEXES = ["need.?le", "n[e]{2}dle", "(func|def) load", "colou?r", "^needle", "needle$", "ne+dle", "(?:open|close)\\(path\\)", "load\\b", ".*", "[a-z]+", "x", "a(b", "needle|absent", "needle|.", "\\d\\d\\d%", "k sign", "(needle){1,3}", "(absent)*needle", "\\bneed", "n(ee|ii)dle", "[[n]]eedle", "(n)eedle\\1?", "\\x6eeedle"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(2)
    words = ["needle", "load", "error", "path", "value", "Return", "σ", "x"]
    more = [(f"r{i}.txt", "\n".join(" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 200)))) for i in range(40)]
    files = spark.createDataFrame(TEXTS + more, "file string, content string").repartition(5)
    whole = files.withColumn("content", F.coalesce("content", F.lit("")))
    return search.Index.build(files, str(tmp_path_factory.mktemp("index"))), split_lines(whole)


def rows(df):
    return collections.Counter(map(tuple, df.select("file", "line", "text").collect()))


@pytest.mark.parametrize("term", LITERALS)
def test_literals(tables, term):
    index, lines = tables
    assert rows(index.hits(term)) == rows(text.hits(lines, term))


@pytest.mark.parametrize("term", REGEXES)
def test_expressions(tables, term):
    index, lines = tables
    assert rows(index.hits(term, regex=True)) == rows(text.hits(lines, term, regex=True))


def test_words_scopes_and_globs(tables):
    index, lines = tables
    for more in ({"whole_word": True}, {"scope": ["a.go", "b.py"]}, {"scope": ["../a.go"]}, {"glob": "*.txt"}, {"regex": True, "whole_word": True}):
        assert rows(index.hits("needle", **more)) == rows(text.hits(lines, "needle", **more)), more


def test_plans():
    assert search.plan("ab") is None and search.plan("a\nbcd") is None and search.plan("AbCd") == [["abc", "bcd"]]
    assert search.plan("foo(bar|baz)qux", regex=True) == [["foo", "qux"]] and search.plan("abc|x", regex=True) is None and search.plan("abc|xyz", regex=True) == [["abc"], ["xyz"]]
    assert search.plan("(abc)?d", regex=True) is None and search.plan("(abcd){2}", regex=True) == [["abc", "bcd"]] and search.plan("a[[b]]cde", regex=True) is None and search.plan("[a-c&&b]cde", regex=True) is None
    assert search.plan("abc(", regex=True) == [["abc", "bc("]] and search.plan("é[a]bcé", regex=True) == [["abc"]] and search.plan("(?x) a b c", regex=True) is None


def test_postings_of_pieces(monkeypatch):
    monkeypatch.setattr(search, "SLICE", 50)
    r = random.Random(1)
    texts = ["".join(r.choices("ab\n", k=n)) for n in (0, 1, 2, 3, 49, 50, 51, 400, 3000)] + ["\n" * 200, "ab\n" * 100]
    got = collections.defaultdict(int)
    for piece in search._pieces(np.arange(len(texts)), texts):
        for g, d, s, m in zip(*(x.tolist() for x in search.postings(*piece)), strict=True):
            got[g, d, s] |= m & (1 << 64) - 1
    want = collections.defaultdict(int)
    for d, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            for i in range(len(line) - 2):
                want[search.codes([line[i : i + 3]])[0], d, n // 64] |= 1 << n % 64
    assert got == want


def test_only_pages_of_the_grams_are_read(spark, tmp_path):
    r = random.Random(3)
    files = spark.createDataFrame([(str(i), " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400))) for i in range(300)], "file string, content string").coalesce(1)
    index = search.Index.build(files, str(tmp_path / "i"))
    total = index.grams.count()
    own = index.grams.where(F.col("gram").isin(search.codes(["qzj"])))
    plan = own._jdf.queryExecution()
    assert "PushedFilters: [In(gram" in plan.toString() or "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan.toString()
    own.count()
    exact = index.grams.where(F.col("gram").isin(search.codes(["qzj"])))
    rows_read = {}
    physical = exact._jdf.queryExecution().executedPlan()
    exact._jdf.queryExecution().toRdd().count()
    todo = [physical]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            rows_read[node.nodeName()] = node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert total > 400_000 and 0 < sum(rows_read.values()) < total / 5, (rows_read, total)


SYMBOLS = [("1", "Load", "pkg.Load", "func Load(path)", "Loads a file", "a.go", 3), ("2", "Loader", "", "type Loader", "", "b.go", 1), ("3", "reload", "", "", "", "mock/c.go", 9), ("4", "Other", "", "", "mentions load here", "d.go", 2), ("5", "Unrelated", "", None, None, "e.go", 5), ("6", "load", "", "", "", "x_test.go", 5)]


def test_symbols_and_one_term(spark, tables, tmp_path):
    index, lines = tables
    symbols = spark.createDataFrame(SYMBOLS, "id string, name string, qualified_name string, signature string, docstring string, file_path string, start int")
    names = search.Index.build(search.symbol_files(symbols), str(tmp_path / "s"))
    for term in ("load", "Loader", "lo", "file", "nothing at all", "load(path) loads", "pkg.load"):
        assert list(map(tuple, search.search_symbols(names, symbols, term, 3).collect())) == list(map(tuple, lookup.search(symbols, term, 3).collect())), term
    one = lambda scope, **more: search.search_one(index, symbols, names, "load", scope, **more).collect()
    got = one("both", files_only=True)
    assert [(x.id, x.test_double) for x in sorted((x for x in got if x.section == "symbol"), key=lambda x: (x.pos, x.text, x.file))] == [("1", False), ("2", False), ("4", False), ("6", True), ("3", True)]
    hits = text.hits(lines, "load")
    assert {(x.file, x.line) for x in got if x.section == "text"} == {(x.file, x.line) for x in text.capped(hits, 50).collect()}
    total = next(x for x in got if x.section == "total")
    assert (total.total, total.files) == (hits.count(), hits.select("file").distinct().count())
    assert {x.section for x in one("symbols")} == {"symbol"} and {x.section for x in one("text", files_only=True)} == {"file", "total"}
    assert sum(x.section == "text" for x in one("text", limit=7)) == 7 and sum(x.section == "text" for x in one("text", exhaustive=True)) == total.total
    with pytest.raises(ValueError):
        one("everything")


def test_references_by_the_index(spark, tables):
    index, lines = tables
    defs = spark.createDataFrame([("a.go", 1, "Load"), ("b.py", 1, "load")], "file string, line int, name string")
    for word in ("load", "Load", "value", "nowhere"):
        assert sorted(map(str, index.references(word, defs).collect())) == sorted(map(str, text.references(lines, word, defs).collect()))


def test_empty_index(spark, tmp_path):
    index = search.Index.build(spark.createDataFrame([], "file string, content string"), str(tmp_path / "e"))
    assert index.hits("needle").isEmpty() and index.hits("ne").isEmpty()


def test_the_index_is_packed(spark, tmp_path):
    search.Index.build(spark.createDataFrame([("f", "some text\nmore text")], "file string, content string"), str(tmp_path / "packed"))
    names = [p.name for p in (tmp_path / "packed").rglob("part-*")]
    assert names and all(".zstd." in n for n in names)
