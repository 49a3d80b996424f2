"""Keys of line deduplication: for the words outside a shared half alone, met without sorting them."""

import pytest

from impactgraph.llm import line_dedup
from tests.llm.test_operators import table


def line(name, n):
    return [f"{name}{i}" for i in range(n)]


@pytest.fixture
def written(monkeypatch):
    """Rows and plan of each scratch table that has been written."""
    found, write = {}, line_dedup.Scratch.write

    def watched(self, df, name):
        out = write(self, df, name)
        found[name] = (out.count(), df._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(line_dedup.Scratch, "write", watched)
    return found


def test_a_shared_half_has_keys_for_the_other_one_alone(spark, written):
    head, tail = line("h", 40), line("t", 41)
    rows = [(1, " ".join(head + line("a", 40))), (2, " ".join(head + line("b", 40))), (3, " ".join(line("c", 41) + tail)), (4, " ".join(line("d", 41) + tail))]
    assert {x.doc_id: x.n_removed for x in line_dedup.dedup(table(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert written["keys"][0] <= 4 * (1 + 41)


def test_keys_are_not_sorted(spark, written):
    base = line("w", 12)
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join([*base[:3], "x", *base[4:]])), (4, " ".join(base[1:]))]
    assert {x.doc_id: x.n_removed for x in line_dedup.dedup(table(spark, rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    for name in ("swap", "meet", "found"):
        assert "SortAggregate" not in written[name][1] and "SortMergeJoin" not in written[name][1], written[name][1]


@pytest.mark.parametrize("block", [256, 11])
def test_an_edit_at_any_word_is_found_in_either_order(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows, d = [], 0
    for n in range(8, 14):
        for i in range(n + 1):
            for kind in ("replaced", "deleted", "inserted"):
                for order in (1, -1):
                    base = line(f"p{d}w", n)
                    edited = base[:i] + ["new"] * (kind != "deleted") + base[i + (kind != "inserted") :]
                    rows += [(d + k, " ".join(x)) for k, x in enumerate((base, edited)[::order])]
                    d += 2
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup(table(spark, rows)).collect()}
    texts = dict(rows)
    # Of 8 words one less makes 7, which has no edits.
    assert got == {x: int(x % 2 == 1 and min(len(texts[x].split()), len(texts[x - 1].split())) >= 8) for x in texts}
