"""Documents with several runs of hit words."""

from impactgraph.llm import decontaminate
from tests.llm.test_operators import table


def test_remove_with_several_spans(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(20)) for x in "tu")
    rows = [(1, f"{one} apart {two}"), (2, f"{one} {'clean ' * 900}{two}"), (3, "clean " * 30), (4, None)]
    bench = spark.createDataFrame([("a", one), ("b", two)], "item_id string, text string")
    docs = table(spark, rows)
    assert sorted(x.doc_id for x in decontaminate.remove(docs, bench).collect()) == [2, 3, 4]
    cut = {x.doc_id: x.text for x in decontaminate.remove(docs, bench, spans=True).collect()}
    assert cut[1].split() == ["apart"] and cut[2].split() == ["clean"] * 900 and cut[3] == "clean " * 30 and cut[4] is None
