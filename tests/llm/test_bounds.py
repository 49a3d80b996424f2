"""What operators broadcast and draw has a bound: parts of a benchmark, numbers of pairs, rows of a label."""

import pickle
import random

from pyspark.sql import functions as F

from impactgraph.llm import decontaminate, language
from impactgraph.llm.common import Scratch, attach


def test_a_built_part_is_a_few_times_its_text():
    r = random.Random(1)
    rows = [(str(i), " ".join(f"w{r.randrange(5000)}" for _ in range(400))) for i in range(500)]
    size = sum(len(t) for _, t in rows)
    assert len(pickle.dumps(decontaminate.grams(rows))) < 6 * size
    boiler = " ".join(f"b{i}" for i in range(40))
    g = decontaminate.grams([("a", boiler + " x " + boiler), ("b", boiler), ("a", boiler)])
    keys, places = g.by_length[13]
    assert len(keys) == 28 + 28 + 13 and [x[2] for x in decontaminate.scan([boiler.encode()], g)] == [[0, 1]]


def test_parts_of_a_benchmark_give_one_report(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(f"i{i}" if i % 7 else None, " ".join(r.choices(words, k=r.choice([2, 5, 13, 60])))) for i in range(40)]
    docs = [(i, " ".join(r.choices(words, k=50)) + " " + (r.choice(items)[1] if i % 2 else "")) for i in range(60)]
    bench, table = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.report(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1000)
    assert len(list(decontaminate._parts(bench, "item_id", 13, Scratch(spark, "parts")))) > 3
    assert sorted(map(tuple, decontaminate.report(table, bench).collect())) == one


def test_rows_with_texts_are_not_broadcast(spark):
    scratch = Scratch(spark, "attach")
    pairs = scratch.write(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), "pairs")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id long, text string")
    one, two = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    got = attach(attach(pairs, "a", one, "b", scratch, "one"), "b", two, "a", scratch, "two", pairs)
    assert {tuple(x) for x in got.select("a", "b", "ta", "tb").collect()} == {(i, i + 1, f"t{i}", f"t{i + 1}") for i in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    marked = [line for line in plan.split("\n") if "ResolvedHint (strategy=broadcast)" in line]
    assert all("ta#" not in line for line in marked)


def test_documents_of_one_id_are_drawn_by_their_texts(spark):
    r = random.Random(3)
    voc = {"en": ["the", "and", "house", "with"], "de": ["der", "und", "haus", "mit"]}
    rows = [(4, " ".join(r.choices(voc[x], k=30)), x) for x in ("en", "de") for _ in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs)
    got = language.predict(docs, m).join(docs.select("doc_id", "text", "lang").distinct().limit(0), "doc_id", "left").select("lang_pred").collect()
    assert m.labels == ["de", "en"] and {x.lang_pred for x in got} == {"de", "en"}
    right = [language.judge([t.encode()], m, m.folded())[0][0] == lang for _, t, lang in rows[::50]]
    assert all(right)
    copies = spark.createDataFrame([(4, "the house", "en")] * 3000, "doc_id long, text string, lang string")
    assert language.fit(copies).labels in ([], ["en"])
    nothing = language.fit(docs.where("FALSE"))
    assert nothing.labels == [] and {x.lang_pred for x in language.predict(docs.limit(3), nothing).collect()} == {"und"}
    many = spark.createDataFrame([(i, f"word{i} text", f"l{i % 700}") for i in range(1400)], "doc_id long, text string, lang string")
    assert len(language.fit(many).labels) == 700
