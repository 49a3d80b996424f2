import pytest
from pyspark.sql import functions as F

from impactgraph.functions import scalars as S


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_tokens_count_bytes(spark):
    assert values(spark, ["", None, "a", "abcd", "éééé", "x" * 41], S.tokens) == [0, 0, 1, 1, 2, 10]


def test_component(spark):
    paths = ["main.go", "a/b/c.go", "/x.go", "a/x.go"]
    assert values(spark, paths, S.component) == ["(root)", "a/b", "(root)", "a"]
    assert values(spark, paths, lambda c: S.component(c, 1)) == ["(root)", "a", "(root)", "a"]


def test_the_four_test_rules_differ(spark):
    paths = ["a/x_test.go", "a/conftest.py", "a/FooTests.java", "pkg/mock_db.go", "spec/a.rb", "a/test_x.py", "src/test/X.kt", "a/x.spec.ts", "latest.go", "a/testdata/x.go"]
    assert values(spark, paths, S.is_view_test) == [True, True, True, False, True, True, True, True, False, True]
    assert values(spark, paths, S.is_test_double) == [True, False, False, True, False, False, False, False, False, True]
    assert values(spark, paths, S.is_verify_test) == [True, False, False, False, False, True, True, True, False, False]
    assert values(spark, paths, S.is_category_test) == [True, False, True, False, False, False, True, True, False, False]


def test_tiers(spark):
    assert values(spark, ["native", "astkit", "tree_sitter", "regex", ""], S.tier) == ["precise", "measured", "structural", "heuristic", "heuristic"]
    assert values(spark, list(S.TIERS) + ["?"], S.tier_rank) == [0, 1, 2, 3, 3]


def test_names(spark):
    assert values(spark, ["a.b.C", "C", ""], S.leaf) == ["C", "C", ""]
    assert values(spark, ["a.go", "A.TSX", "Makefile", "a.hpp"], S.language_tag) == ["go", "typescript", "", "cpp"]
    assert values(spark, ["", "gpt-3.5", "GPT-4o", "gemini-2.0", "gemini-1", "x"], S.context_window) == [200000, 16000, 128000, 1000000, 128000, 128000]


@pytest.mark.parametrize("word, text, hit", [("implement", "implementation", False), ("add", "please ADD it", True), ("pr", "a_pr", False), ("what is", "what is it", True), ("fix", "préfixe", False)])
def test_whole_words(spark, word, text, hit):
    assert values(spark, [text], lambda c: S.contains_word(c, word)) == [hit]


def test_cuts(spark):
    assert values(spark, ["  ab ", "abcdef"], lambda c: S.summarize(c, 4)) == ["ab", "abcd…"]
    assert values(spark, ["x\r", "y" * 251], S.hit_line) == ["x", "y" * 250 + "…"]
    long = "a\n" + "b" * 1300
    assert values(spark, ["short", long], S.clamp_lines) == ["short", "a\n" + "b" * 1200 + "… [line truncated: 1300 bytes]"]


def test_markdown_const(spark):
    md = "x\n## A\n- item one\n|---|\ny\nz"
    assert values(spark, [md, "## A\n## B\n## C", "\n\n\n\n\n\n"], S.is_markdown_const) == [True, False, False]


def test_globs():
    import re

    assert re.match(S.glob_regex("a/*"), "a/b") and not re.match(S.glob_regex("a/*"), "a/b/c")
    assert re.match(S.glob_regex("v[12].?"), "v2.x") and not re.match(S.glob_regex("v[12].?"), "v3.x")


def test_bad_regex_is_literal(spark):
    assert values(spark, ["f(x", "fx"], lambda c: c.rlike(S.pattern("f(", regex=True))) == [True, False]


def test_indent(spark):
    assert values(spark, ["\tx", "  x", " \t x"], S.indent_width) == [4, 2, 6]
