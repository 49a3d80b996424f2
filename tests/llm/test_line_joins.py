"""Join kinds of line deduplication: what is shuffled may not jump with the size of the input."""

from impactgraph.llm import line_dedup
from tests.llm.test_operators import table


def test_texts_are_joined_once_at_any_size(spark):
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{line}\nshort\n{line}"), (2, f"other\n{line} more"), (3, None), (4, "apart"), (5, "")]
    got = line_dedup.dedup(table(spark, rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 1 and "LeftOuter" in joins[0] and "strategy=shuffle_hash" in joins[0], plan
    assert sorted(map(tuple, got.collect())) == [(1, f"{line}\nshort", 3, 1), (2, "other", 2, 1), (3, None, 0, 0), (4, "apart", 1, 0), (5, "", 1, 0)]


def test_keys_meet_without_broadcasts_by_estimate(spark, monkeypatch):
    """Tables of computed size are broadcast by a counted bound alone: with none allowed, no plan has a broadcast."""
    monkeypatch.setattr(line_dedup, "few", lambda *_: False)
    plans, write = [], line_dedup.Scratch.write

    def watched(self, df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(line_dedup.Scratch, "write", watched)
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{line}\nshort"), (2, f"{line} more"), (3, line.replace("w3", "x")), (4, line)]
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}
    assert not [name for name, plan in plans if name in ("copies", "found", "gone") and "BroadcastHashJoin" in plan]
