from __future__ import annotations

import random

import pytest

from lacuna.operators.gaps import find_bridges, find_gaps, gap_pairs, gaps_with_bridges
from lacuna.operators.labels import incidence, label_graph, neighbours, top_labels
from lacuna.params import CONCEPTS, LabelFilter, valid_limit, valid_min_score
from tests.corpora import frame, ten, work

CONCEPT = LabelFilter(CONCEPTS)


def names(df):
    return [r["name_a"] + r["name_b"] for r in df.orderBy("rank").collect()]


def test_filter_bounds_are_inclusive_and_labels_distinct(spark):
    tags = [("a", "a", 2, 0.4), ("b", "b", 1, 0.4), ("c", "c", 2, 0.399999), ("a", "later", 5, 0.9)]
    rows = incidence(frame(spark, [work(0, concepts=tags)]), CONCEPT).collect()
    assert [(r["label_id"], r["name"], r["pos"]) for r in rows] == [("a", "a", 0)]


def test_topics_ignore_levels(spark):
    assert incidence(frame(spark, [work(0, labels="AB")]), LabelFilter(min_level=5, min_score=0.9)).count() == 2


def test_graph_counts(spark):
    g = label_graph(ten(spark), CONCEPT)
    rows = {r["name"]: r for r in neighbours(g).collect()}
    assert g.n_works == 10
    assert {k: r["works"] for k, r in rows.items()} == {"A": 8, "B": 6, "C": 5, "D": 4}
    assert {k: r["strength"] for k, r in rows.items()} == {"A": 13, "B": 9, "C": 6, "D": 8}
    assert rows["A"]["top_neighbor"] == "B"
    assert [r["concept"] for r in top_labels(g, 2).orderBy("rank").collect()] == ["A", "B"]


def test_gap_values_and_order(spark):
    g = label_graph(ten(spark), CONCEPT)
    assert names(find_gaps(g, 3)) == ["BC", "AC", "AB", "AD"]
    assert names(find_gaps(g, 5)) == ["BC", "AC", "AB"]
    r = {x["name_a"] + x["name_b"]: x for x in find_gaps(g, 3).collect()}
    assert (r["BC"]["observed"], r["BC"]["expected"], r["BC"]["lift"]) == (1, 3.0, 1 / 3)
    assert (r["AB"]["expected"], r["AB"]["lift"]) == (4.8, 1.25)


def test_top_is_a_prefix(spark):
    g = label_graph(ten(spark), CONCEPT)
    every = names(find_gaps(g, 3, 100))
    for k in range(5):
        assert names(find_gaps(g, 3, k)) == every[:k]


def test_equal_names_keep_the_order_of_the_corpus(spark):
    twins = [("z", "Twin"), ("a", "Twin")]
    works = [work(i, labels=[*twins, "Hub"] if i < 4 else [*twins] if i < 8 else ["Hub"]) for i in range(12)]
    g = label_graph(frame(spark, works), CONCEPT)
    assert [r["label_id_b"] for r in find_gaps(g, 3).where("name_a = 'Hub'").orderBy("rank").collect()] == ["C-z", "C-a"]
    assert {r["name"]: r["top_neighbor"] for r in neighbours(g).collect()}["Hub"] == "Twin"


def test_empty_corpus(spark):
    g = label_graph(frame(spark, []), CONCEPT)
    assert g.n_works == 0
    assert find_gaps(g).count() == 0
    assert top_labels(g, 5).count() == 0


def bridge_corpus(spark):
    sets = {"A": set(range(1, 13)), "C": set(range(13, 25)), "Hub": set(range(1, 41)), "B1": {1, 2, 3, 13, 14, 15}, "Bz": {1, 2, 3, 13, 14, 15}}
    sets |= {"B2": {*range(1, 6), *range(13, 18), 25, 26}, "B3": {1, 2, 13, 14}, "B4": {*range(1, 9), 13, 14, 15, *range(25, 37)}}
    return frame(spark, [work(i, labels=[n for n, s in sets.items() if i in s]) for i in range(1, 41)])


def test_bridges(spark):
    g = label_graph(bridge_corpus(spark), CONCEPT)
    gaps = find_gaps(g, 3, 100).where("name_a = 'A' and name_b = 'C'")
    rows = find_bridges(g, gaps, 3, 10).orderBy("place").collect()
    assert [(r["bridge"], r["observed_a"], r["observed_c"]) for r in rows] == [("B1", 3, 3), ("Bz", 3, 3), ("B2", 5, 5)]
    assert [r["bridge"] for r in find_bridges(g, gaps, 7, 10).collect()] == ["B2"]
    cells = {(r["concept_a"], r["concept_b"]): r["bridges"] for r in gaps_with_bridges(g, 3, 100, 2).collect()}
    assert cells["A", "C"] == "B1 (3|3); Bz (3|3)"
    assert "" in cells.values()


def test_gaps_equal_brute_force(spark):
    rnd = random.Random(5)
    docs = [rnd.sample("ABCDEFGH", rnd.randint(0, 5)) for _ in range(60)]
    g = label_graph(frame(spark, [work(i, labels=d) for i, d in enumerate(docs)]), CONCEPT)
    got = {(r["name_a"], r["name_b"]): (r["observed"], r["expected"]) for r in gap_pairs(g, 4).collect()}
    want = {}
    for i, a in enumerate("ABCDEFGH"):
        for b in "ABCDEFGH"[i + 1 :]:
            wa, wb = sum(a in d for d in docs), sum(b in d for d in docs)
            if min(wa, wb) >= 4 and wa * wb >= 3 * 60:
                want[a, b] = (sum(a in d and b in d for d in docs), wa * wb / 60)
    assert got == want


@pytest.mark.parametrize("bad", ["nan", "-0.1", "1.1", "x", "inf"])
def test_min_score_is_checked(bad):
    with pytest.raises(ValueError):
        valid_min_score(bad)


def test_limits():
    assert valid_min_score(" 0.5 ") == 0.5
    assert valid_limit("7") == 7
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError):
            valid_limit(bad)


def test_pairing_by_ranges_equals_the_broadcast(spark, monkeypatch):
    from lacuna.operators import gaps

    rows = [(f"L{i}", f"N{i % 50}", 2, 1 + i * i % 97, (i, 0)) for i in range(120)]
    labels = spark.createDataFrame(rows, "label_id string, name string, level int, works bigint, first struct<ord: bigint, pos: int>")
    want = sorted(map(str, gaps.candidate_pairs(labels, 300, 2).collect()))
    assert len(want) > 100
    monkeypatch.setattr(gaps, "BROADCAST_LABELS", 10)
    for part in (7, 1_000):
        monkeypatch.setattr(gaps, "PART_LABELS", part)
        ranged = gaps.candidate_pairs(labels, 300, 2)
        assert sorted(map(str, ranged.collect())) == want
        plan = ranged._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_many_terms_hit_as_few_do(spark, monkeypatch):
    from lacuna.operators import textcheck

    corpus = spark.createDataFrame([(1, " one two three "), (2, " two three "), (3, " "), (4, " three one two two ")], "ord bigint, text string")
    terms = spark.createDataFrame([("a", " one "), ("b", " two three "), ("b", " three "), ("c", " one two "), ("d", " two two "), ("e", " wo ")], "label_id string, term string")
    want = sorted(map(tuple, textcheck.text_hits(corpus, terms).collect()))
    assert want == [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (4, "a"), (4, "b"), (4, "c"), (4, "d")]
    monkeypatch.setattr(textcheck, "SENT_TERMS", 2)
    assert sorted(map(tuple, textcheck.text_hits(corpus, terms).collect())) == want
