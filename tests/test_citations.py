from __future__ import annotations

import pytest

from lacuna.operators.citations import citation_edges, in_degree, nodes, pagerank, stats, top_cited
from tests.corpora import frame, work


def ranks(spark, works):
    w = frame(spark, works)
    return {r["id"]: r["pagerank"] for r in pagerank(nodes(w).select("id"), citation_edges(w)).collect()}


def test_two_nodes(spark):
    r = ranks(spark, [work(0, "A", refs=["B"]), work(1, "B")])
    # b = (1-d)/2 + d (a + b/2), a = (1-d)/2 + d b/2
    d = 0.85
    a = ((1 - d) / 2 + d / 2) / (1 + d / 2)
    assert r["A"] == pytest.approx(a, abs=1e-9)
    assert sum(r.values()) == pytest.approx(1)


def test_cycle_star_and_dangling(spark):
    assert all(v == pytest.approx(1 / 3) for v in ranks(spark, [work(0, "A", refs=["B"]), work(1, "B", refs=["C"]), work(2, "C", refs=["A"])]).values())
    star = ranks(spark, [work(0, "hub"), *[work(i, f"s{i}", refs=["hub"]) for i in range(1, 5)]])
    assert max(star, key=star.get) == "hub"
    assert all(v == pytest.approx(0.25) for v in ranks(spark, [work(i) for i in range(4)]).values())
    assert ranks(spark, []) == {}


def test_fixpoint(spark):
    works = [work(0, "A", refs=["B", "C"]), work(1, "B", refs=["C"]), work(2, "C", refs=["A"]), work(3, "D", refs=["C"]), work(4, "E")]
    r = ranks(spark, works)
    out = {"A": ["B", "C"], "B": ["C"], "C": ["A"], "D": ["C"], "E": []}
    for x in r:
        given = sum(r[s] / len(t) for s, t in out.items() if x in t)
        assert r[x] == pytest.approx(0.15 / 5 + 0.85 * (given + r["E"] / 5), abs=1e-8)


def test_edges_leave_out_externals_selves_and_repeats(spark):
    w = frame(spark, [work(0, "A", refs=["B", "B", "A", "X"]), work(1, "B"), work(2, "A", refs=["B", "Y"])])
    assert [tuple(r) for r in citation_edges(w).collect()] == [("A", "B")]
    assert {r["id"]: r["in_corpus_citations"] for r in in_degree(w).collect()} == {"A": 0, "B": 1}
    s = stats(w).first()
    assert (s["works"], s["internal_edges"], s["total_references"]) == (2, 1, 3)
    assert s["internal_ratio"] == pytest.approx(1 / 3)


def test_stats_of_nothing(spark):
    s = stats(frame(spark, [])).first()
    assert (s["works"], s["internal_ratio"], s["year_min"]) == (0, 0.0, None)


def test_top_cited(spark):
    w = frame(spark, [work(0, "A", title="x" * 61), work(1, "B", refs=["A"], title="t" * 60), work(2, "C", refs=["A"])])
    rows = top_cited(w, 2).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["A", "B"]
    assert rows[0]["title"] == "x" * 59 + "…"
    assert rows[1]["title"] == "t" * 60
