"""A reference that most sections have is resolved without a shuffle by its text."""

import pytest

from granary.operators import graph as G


@pytest.fixture(scope="module")
def rows(spark):
    symbols = [(i, f"m{i % 4}.C{i % 3}.op_{i % 2}", f"C{i % 3}.op_{i % 2}") for i in range(40)]
    refs = [(i, 0, "op_1()" if i % 9 else "M1.c0.OP_1") for i in range(200)] + [(3, 1, ""), (4, 1, "none")]
    return (
        spark.createDataFrame(refs, "section_id long, pos int, ref string"),
        spark.createDataFrame(symbols, "seq long, symbol_id string, qualname string"),
    )


def resolved(refs, symbols):
    return {(r["section_id"], r["symbol_id"], r["pos"]) for r in G.resolve_refs_tiered(refs, symbols).collect()}


def test_common_references_are_not_sorted_into_one_task(rows):
    plan = G.resolve_refs_tiered(*rows)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if " Join " in line or line.startswith("Join ")]
    assert joins and all("strategy=broadcast" in line for line in joins)


def test_long_symbol_tables_are_joined_alike(rows, monkeypatch):
    few = resolved(*rows)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 1)
    assert resolved(*rows) == few
    by_tail = {s for i, s, _ in few if i == 1}
    assert by_tail == {f"m{i % 4}.C{i % 3}.op_1" for i in range(40) if i % 2}
    assert {s for i, s, _ in few if i == 9} == {"m1.C0.op_1"}
