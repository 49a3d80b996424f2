"""Language identification: the vectorised forward pass against a plain one, and accuracy on rows held out."""

import math
import os
import random

import numpy as np
import pytest

from impactgraph.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain(text, m):
    """Score of each label: n-grams one by one, embeddings averaged, then the linear layer and the softmax."""
    low = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in text.encode())
    total, n = [0.0] * language.WIDTH, 0
    for k in language.GRAMS:
        for i in range(len(low) - k + 1):
            g = int.from_bytes(low[i : i + k], "little")
            h = ((g ^ k) * 0x9E3779B1 % (1 << 32)) >> 18
            total = [a + float(b) for a, b in zip(total, m.embedding[h], strict=True)]
            n += 1
    z = [sum(total[w] / n * float(m.weight[w, j]) for w in range(language.WIDTH)) + float(m.bias[j]) for j in range(len(m.labels))]
    e = [math.exp((x - max(z)) / m.temperature) for x in z]
    return [x / sum(e) for x in e]


def test_judge_is_the_plain_forward_pass():
    r = np.random.default_rng(5)
    m = language.Model(["aa", "bb", "cc"], r.normal(0, 1, (language.BUCKETS, language.WIDTH)).astype(np.float32), r.normal(0, 1, (language.WIDTH, 3)).astype(np.float32), r.normal(0, 1, 3).astype(np.float32), 0.7)
    pick = random.Random(1)
    texts = ["".join(pick.choices("abcÉ ü\tZñ.7", k=pick.randint(5, 200))) + "x" for _ in range(40)]
    for t, (label, score) in zip(texts, language.judge([t.encode() for t in texts], m, m.folded()), strict=True):
        want = plain(t, m)
        assert m.labels[int(np.argmax(want))] == label and abs(max(want) - score) < 1e-3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    rows = queries.op8_language(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    right = sum(x.lang_pred == x.lang for x in rows)
    assert len(rows) > 150 and right >= 0.97 * len(rows)
