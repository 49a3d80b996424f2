"""Stages of the corpus pipeline on Spark against brute force."""

import random

import pytest

from tests.llm.test_operators import table, words

pytest.importorskip("public_tokenizers")


def jaccard(a, b, n):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_stage_links_from_four_fifths_of_five_words(spark):
    import corpus_pipeline

    r = random.Random(4)
    docs, gap = {}, 0
    for base in range(20):
        w = [f"b{base}w{i}" for i in range(100)]
        docs[10 * base] = w
        docs[10 * base + 1] = w[: r.randint(76, 84)]
        other = list(w)
        for i in r.sample(range(100), r.randint(1, 3)):
            other[i] = f"b{base}x{i}"
        docs[10 * base + 2] = other
    docs |= {900: words(r, ["a", "b"], 3), 901: [f"b0w{i}" for i in range(100)][:30]}
    root = {d: d for d in docs}
    for d in sorted(docs):
        for e in sorted(docs):
            if e < d and jaccard(docs[d], docs[e], 5) >= 0.8:
                gap += jaccard(docs[d], docs[e], 4) < 0.85
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert gap > 10
    got = corpus_pipeline.near_duplicates_stage(spark, table(spark, [(d, " ".join(w)) for d, w in docs.items()]), "")
    assert sorted(x.doc_id for x in got.collect()) == sorted(d for d in docs if root[d] == d)


def test_stages_on_nothing_and_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, __domain string, spans int"
    spark.createDataFrame([("b", "never seen words")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", "", "", 0, "k", "d", 1), (1, "", "", "", 0, "k", "d", 1), (None, "a  b", "en", None, 3, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, str(tmp_path))
        assert got.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == none.columns and stage(spark, odd, str(tmp_path)).columns == none.columns, name
    ids = lambda df: sorted((x.doc_id or 0, x.text or "") for x in df.collect())
    assert ids(corpus_pipeline.near_duplicates_stage(spark, odd, "")) == ids(odd)  # texts without words are no copies
    assert ids(corpus_pipeline.benchmark_stage(spark, odd, str(tmp_path))) == ids(odd)
    assert corpus_pipeline.tokens_stage(spark, odd, str(tmp_path)).count() == 4
