"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams after lower-casing A-Z, hashed into BUCKETS; their embeddings are averaged over the
whole text and a linear layer gives a logit for each language. The model is fitted on the driver, on at most PER_LABEL rows
of each label (features are counted on executors, so that a row's size on the driver is bounded by BUCKETS). Logits are
scaled by a temperature and a rejection threshold is set on rows that the training did not see.

A null text or one without a letter is `und` with score 0, as is every text when there are no labelled rows. Rows are
judged one by one, by text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.llm import hashing
from impactgraph.llm.common import bound_batches, texts_of

BUCKETS, GRAMS, WIDTH = 1 << 14, (2, 4), 16
#: Labelled rows of each language that the fit may see, and of all; with very many languages each has fewer, one at least.
PER_LABEL, ROWS = 600, 300_000
#: Texts that the model gets right and would reject, at most, on the rows that set the threshold.
LOSS = 0.002
#: Beyond this score nothing is rejected.
SURE = 0.5

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_SOME = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _SOME.finditer(text))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams, one array of BUCKETS."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.translate(_TABLE)
    for at in range(0, len(text), _PIECE):
        b = np.frombuffer(text[at : at + _PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            m = min(len(b) - n + 1, _PIECE)
            if m > 0:
                g = b[:m].copy()
                for j in range(1, n):
                    g |= b[j : j + m] << np.uint32(8 * j)
                g = (g ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                out += np.bincount(g >> np.uint32(18), minlength=BUCKETS)
    return out


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray  # BUCKETS x WIDTH
    weight: np.ndarray  # WIDTH x labels
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def folded(self) -> np.ndarray:
        return (self.embedding @ self.weight).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 4.0, seed: int = 7) -> Model:
    """rows: (bucket, count) arrays of each text. Every fifth row is held back for calibration."""
    rng = np.random.default_rng(seed)
    m = Model(labels, rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for i, r in enumerate(which):
            at, n = rows[r]
            x[i, at] = n / max(1, n.sum())
        return x

    own = np.flatnonzero(~held)
    for turn in range(epochs):
        rng.shuffle(own)
        for a in range(0, len(own), batch):
            part = own[a : a + batch]
            x = dense(part)
            v = x @ m.embedding
            d = _softmax(v @ m.weight + m.bias)
            d[np.arange(len(part)), y[part]] -= 1
            step = rate * (1 - turn / epochs) / len(part)
            g = d @ m.weight.T
            m.weight -= step * (v.T @ d)
            m.bias -= step * d.sum(0)
            m.embedding -= step * 40 * (x.T @ g)
    if held.any():
        at = np.flatnonzero(held)
        z = np.concatenate([dense(at[i : i + 256]) @ m.embedding @ m.weight + m.bias for i in range(0, len(at), 256)])
        grid = np.geomspace(0.1, 10, 41)
        m.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(at)), y[at]] + 1e-12).mean()))
        p = _softmax(z / m.temperature)
        good = p.max(1)[p.argmax(1) == y[at]]
        m.threshold = float(min(SURE, np.quantile(good, LOSS))) if len(good) else 0.0
    return m


def fit(docs: DataFrame, label: str = "lang", where: str = "TRUE") -> Model:
    """A model from at most PER_LABEL rows of each label, ROWS in all, among those that `where` lets in, picked by a hash of
    doc_id and text. Without such rows it knows no label, and every text is `und`."""
    bound_batches(docs.sparkSession)
    own = docs.where(where).where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("y"), "doc_id", "text")
    sizes = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    per = max(1, min(PER_LABEL, ROWS // max(1, len(sizes))))
    part = docs.sparkSession.createDataFrame([(k, min(1.0, 1.2 * per / n + 20 / n)) for k, n in sizes.items()], "y string, part double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = own.join(F.broadcast(part), "y").withColumn("draw", draw).where(F.col("draw") < F.col("part") * (1 << 30))
    # Rows that are equal are drawn together, so that the first of a label's are taken in order.
    rank = F.row_number().over(W.partitionBy("y").orderBy("draw", "doc_id"))
    picked = drawn.withColumn("rank", rank).where(F.col("rank") <= per).select("y", "doc_id", "draw", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for t in texts_of(batch.column("text")):
                f = features(t)
                nz = np.flatnonzero(f)
                at.append(nz.astype("<u2").tobytes())
                n.append(f[nz].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id").cast(pa.int64()), batch.column("draw"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["y", "doc_id", "draw", "at", "n"])

    rows = picked.mapInArrow(count, "y string, doc_id long, draw long, at binary, n binary").toPandas().sort_values(["draw", "y", "doc_id"])
    labels = sorted(set(rows["y"]))
    if not labels:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    pairs = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(n, "<f4")) for a, n in zip(rows["at"], rows["n"], strict=True)]
    return train(pairs, rows["y"].map({k: i for i, k in enumerate(labels)}).to_numpy(), labels)


def judge(texts: list[bytes], model: Model, folded: np.ndarray) -> list[tuple[str, float]]:
    out = []
    for t in texts:
        if not model.labels or not has_letter(t.decode()):
            out.append(("und", 0.0))
            continue
        f = features(t)
        p = _softmax(((f @ folded) / max(1, f.sum()) + model.bias) / model.temperature)
        i = int(p.argmax())
        out.append((model.labels[i], float(p[i])))
    return out


def predict(docs: DataFrame, model: Model, held_out: str = "FALSE") -> DataFrame:
    """One row per document, as SCHEMA has it. No shuffle."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model, model.folded()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(texts_of(batch.column("text")), *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text").mapInArrow(rows, SCHEMA)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without texts that are `und` or score below the model's threshold. Columns stay as they are."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model, model.folded()))

    @F.pandas_udf("boolean")
    def known(column: pd.Series) -> pd.Series:
        model, folded = sent.value
        got = judge([(t or "").encode() for t in column], model, folded)
        return pd.Series([lang != "und" and score >= model.threshold for lang, score in got], dtype=bool)

    return docs.where(known(F.col("text")))
