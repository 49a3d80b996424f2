"""The corpus pipeline: language identification, near-duplicate removal, decontamination, mixing, token files.

Each stage takes all that its predecessor kept. All but the last return rows with the columns of documents; the last
returns what the token files hold of every document. Language identification learns from labelled rows that are not
held out, as the query of that operator does. A drawn document stands once for each of its epochs.

Null texts are rejected by the first stage. Null sources and languages are sources and languages of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactgraph.llm import decontaminate, language, mixture, ngram_join, token_files
from impactgraph.llm.common import Scratch
from impactgraph.llm.queries import HELD_OUT, table, tokenizer_path

#: Near-duplicates of the corpus: words of a shingle, and the similarity in hundredths. Those of op9 are its own contract's.
NEAR_N, NEAR_PERCENT = 5, 80

#: SQL can't train the language model.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs, where=f"NOT ({HELD_OUT})"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=NEAR_N, percent=NEAR_PERCENT)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.encode_and_check(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each other stage keeps is written once and read by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{at}")
    return docs
