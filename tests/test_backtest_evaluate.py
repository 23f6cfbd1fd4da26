from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lacuna.functions.ranks import auroc, auroc_stratified, empirical_p, precision_at
from lacuna.operators import backtest as bt
from lacuna.operators import permutation
from lacuna.operators.evaluate import evaluable, evaluate, pseudo_random, scores
from lacuna.operators.permutation import MULTIPLIER, NULL_SEED, SWEEPS, counted, draws, jump, shuffled, step
from lacuna.params import CONCEPTS, LabelFilter
from tests.corpora import frame, work

CONCEPT = LabelFilter(CONCEPTS)


def replay_corpus(spark):
    train = {"A": range(1, 7), "B": range(7, 13), "D": [*range(1, 5), *range(7, 10)], "F": [1, 7]}
    test = {"E": range(1, 9), "F": range(1, 9), "A": range(1, 7), "B": range(3, 9)}
    works = [work(i, labels=[n for n, s in train.items() if i in s], year=2019 if i % 2 else 2020) for i in range(1, 13)]
    works += [work(100 + i, labels=[n for n, s in test.items() if i in s], year=2021) for i in range(1, 9)]
    return frame(spark, [*works, work(999, labels="ABD", year=None)])


def test_backtest(spark):
    r = bt.backtest(replay_corpus(spark), CONCEPT, 2020, 3)
    assert (r.train.n_works, r.test.n_works, r.undated) == (12, 8, 1)
    rows = {x["name_a"] + x["name_b"]: x for x in r.pairs.collect()}
    assert set(rows) == {"AB", "AD", "BD"}
    ab = rows["AB"]
    assert (ab["observed"], ab["expected"], ab["test_observed"], ab["test_expected"]) == (0, 3.0, 4, 4.5)
    assert ab["test_lift"] == pytest.approx(4 / 4.5)
    assert (rows["BD"]["test_expected"], rows["BD"]["test_lift"]) == (0, None)
    assert [x["concept_a"] + x["concept_b"] for x in bt.backtest_rows(r).collect()] == ["AB"]


def test_summary_has_all_cohorts(spark):
    rows = bt.backtest_summary(bt.backtest(replay_corpus(spark), CONCEPT, 2020, 3), 5).collect()
    assert [r["cohort"] for r in rows] == ["top_5_gaps", *bt.BUCKETS, "all_candidates"]
    assert [r["pairs"] for r in rows] == [1, 1, 0, 1, 1, 0, 3]
    assert rows[2]["hit_rate"] is None
    empty = bt.backtest_summary(bt.backtest(replay_corpus(spark), CONCEPT, 1900, 3), 5).collect()
    assert [r["pairs"] for r in empty] == [0] * 7


def evaluation_corpus(spark):
    """Twenty works a period, four labels on ten each; observed counts of the six pairs differ by period."""
    def period(first, year, sets):
        return [work(first + i, labels=[n for n in "ABCD" if i in sets[n]], year=year) for i in range(20)]

    train = {"A": set(range(10)), "B": {*range(5), *range(10, 15)}, "C": set(range(10, 20))}
    train["D"] = {*range(5, 10), *range(15, 20)}
    test = {"A": set(range(10)), "B": {*range(5), *range(10, 15)}, "C": set(range(10, 20)), "D": {0, 5, 10, 11, *range(15, 20), 12}}
    return frame(spark, [*period(0, 2020, train), *period(100, 2022, test)])


def test_evaluate_equals_brute_force(spark):
    r = bt.backtest(evaluation_corpus(spark), CONCEPT, 2021, 3)
    pairs = evaluable(r).collect()
    assert len(pairs) == 6
    rows = evaluate(r, top=2, permutations=5).collect()
    assert [x["scorer"] for x in rows][0] == "lift"
    got = {x["scorer"]: x for x in rows}
    s = {(x["scorer"], x["name_a"] + x["name_b"]): (x["score"], x["label"]) for x in scores(evaluable(r), r).collect()}
    for name, row in got.items():
        pos = [v for (n, _), (v, y) in s.items() if n == name and y]
        neg = [v for (n, _), (v, y) in s.items() if n == name and not y]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert row["auroc"] == pytest.approx(want), name
        assert row["permutations"] <= 5
    assert got["lift"]["delta"] is None
    assert got["random"]["p_value"] is None or 1 / 6 <= got["random"]["p_value"] <= 1


def test_evaluation_ignores_the_order_of_the_corpus(spark):
    w = evaluation_corpus(spark)
    flipped = w.withColumn("ord", 1000 - w["ord"])
    a, b = (evaluate(bt.backtest(x, CONCEPT, 2021, 3), top=2, permutations=4).collect() for x in (w, flipped))
    assert a == b


def test_no_candidates(spark):
    rows = evaluate(bt.backtest(evaluation_corpus(spark), CONCEPT, 1900, 3), permutations=3).collect()
    assert len(rows) == 7
    assert all(r["pairs"] == 0 and r["auroc"] is None and r["precision_at_k"] is None for r in rows)


def scored(spark, rows):
    return spark.createDataFrame([("s", float(x), bool(y)) for x, y in rows], "scorer string, score double, label boolean")


def test_auroc_and_precision_equal_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(4):
        rows = [(rnd.randrange(5), rnd.random() < 0.4) for _ in range(30)]
        pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        df = scored(spark, rows)
        assert auroc(df, ["scorer"]).first()["auroc"] == pytest.approx(want)
        k = rnd.randint(1, 30)
        total, left = 0.0, k
        for x in sorted({x for x, _ in rows}, reverse=True):
            tie = [y for v, y in rows if v == x]
            take = min(left, len(tie))
            total, left = total + sum(tie) * take / len(tie), left - take
        from pyspark.sql import functions as F

        assert precision_at(df.withColumn("k", F.lit(k)), ["scorer"]).first()["precision"] == pytest.approx(total / k)


def test_auroc_undefined_and_signed_zero(spark):
    assert auroc(scored(spark, [(1, True)]), ["scorer"]).first()["auroc"] is None
    assert auroc(scored(spark, [(-0.0, True), (0.0, False)]), ["scorer"]).first()["auroc"] == 0.5


@pytest.mark.parametrize(("bins", "want"), [(2, 1.0), (1, 0.75)])
def test_strata(spark, bins, want):
    rows = [("s", 1.0, False, 0, 4), ("s", 2.0, True, 1, 4), ("s", 3.0, False, 2, 4), ("s", 4.0, True, 3, 4)]
    df = spark.createDataFrame(rows, "scorer string, score double, label boolean, place bigint, n bigint")
    assert auroc_stratified(df, ["scorer"], bins).first()["auroc_stratified"] == want


def test_empirical_p():
    null = [-1.0, 0.0, 1.0, 2.0]
    assert [empirical_p(x, null) for x in (-1, 2, 3, 0.5)] == [0.6, 0.6, 0.2, 1.0]
    assert empirical_p(1.0, []) is None


def plain_shuffle(docs, state):
    """Swap by swap, one draw after the other."""
    docs = [list(d) for d in docs]
    where = [(i, k) for i, d in enumerate(docs) for k in range(len(d))]
    for _ in range(SWEEPS * len(where)):
        state = step(state)
        a, i = where[(state * MULTIPLIER) % 2**64 % len(where)]
        state = step(state)
        b, j = where[(state * MULTIPLIER) % 2**64 % len(where)]
        x, y = docs[a][i], docs[b][j]
        if a != b and x != y and y not in docs[a] and x not in docs[b]:
            docs[a][i], docs[b][j] = y, x
    return docs


def test_shuffle_keeps_margins():
    docs = [[0, 1, 4] if i % 2 else [2, 3, 5] for i in range(40)]
    doc, label = np.repeat(np.arange(40), 3), np.concatenate(docs)
    out = shuffled(doc, label, NULL_SEED).reshape(40, 3)
    assert out.tolist() == plain_shuffle(docs, NULL_SEED)
    assert all(len(set(d)) == 3 for d in out.tolist())
    assert np.array_equal(np.bincount(out.ravel()), np.bincount(label))
    joint = sum(0 in d and 1 in d for d in out.tolist())
    assert joint < 20
    assert counted(doc, out.ravel(), 6, np.array([0 * 6 + 1, 2 * 6 + 3])).tolist() == [joint, sum(2 in d and 3 in d for d in out.tolist())]
    assert len(shuffled(np.zeros(0, np.int64), np.zeros(0, np.int64), NULL_SEED)) == 0


def test_shuffle_is_that_of_one_swap_after_the_other(monkeypatch):
    rng = np.random.default_rng(3)
    for works, labels, most in ((1, 5, 4), (2, 5, 4), (60, 12, 9), (400, 60, 20)):
        docs = [sorted(rng.choice(labels, rng.integers(1, most), replace=False).tolist()) for _ in range(works)]
        docs[-1] = list(range(labels))  # one work of all labels
        doc, label = np.repeat(np.arange(works), [len(d) for d in docs]), np.concatenate(docs)
        want = [x for d in plain_shuffle(docs, NULL_SEED) for x in d]
        for cells in (permutation.MAX_CELLS, 0):
            monkeypatch.setattr(permutation, "MAX_CELLS", cells)
            assert shuffled(doc, label, NULL_SEED).tolist() == want
        monkeypatch.undo()


def test_draws_are_the_stream():
    x, want = NULL_SEED, []
    for _ in range(1000):
        x = step(x)
        want.append((x * MULTIPLIER) % 2**64)
    assert draws(NULL_SEED, 1000).tolist() == want


def test_jump_equals_stepping():
    x = NULL_SEED
    for i in range(200):
        assert jump(NULL_SEED, i) == x
        x = step(x)


def test_pseudo_random():
    assert 0 <= pseudo_random("a", "b") < 1
    assert pseudo_random("a", "b") != pseudo_random("b", "a")


def test_split_year(spark):
    w = frame(spark, [work(i, year=y) for i, y in enumerate([2000, 2001, 2001, 2002, None])])
    assert bt.split_year(w).first()["year"] == 2001


def test_registered_permutations_can_give_a_win_and_a_loss(spark, monkeypatch):
    from lacuna.operators.evaluate import EVALUATION
    from lacuna.plans import queries as plans

    asked = []

    def planted(result, positive, top, permutations):
        """One scorer far below the reference, one far above, one like it; their nulls are of the permutations asked for."""
        asked.append(permutations)
        null = [(-1) ** i * 0.01 for i in range(permutations)]
        rows = [("lift", None, None, 0.7)] + [(s, d, empirical_p(d, null), 0.7 - d) for s, d in (("jaccard", 0.3), ("adamic_adar", -0.3), ("random", 0.005))]
        return spark.createDataFrame([(s, 9, 4, 0.4, 0.7, strat, 0.5, 0.2, d, 0.0 if d else None, p, permutations, 2, 0.5, 0.5, None, None) for s, d, p, strat in rows], EVALUATION)

    monkeypatch.setattr(plans, "replay", lambda *a: None)
    monkeypatch.setattr(plans, "evaluate", planted)
    got = {r["scorer"]: r["outcome"] for r in plans.queries()["wins"](spark, "").collect()}
    assert got == {"jaccard": "win", "adamic_adar": "loss", "random": "tie"}
    for name in ("evaluate_co_tagged", "evaluate_above_chance"):
        plans.queries()[name](spark, "")
    assert asked == [200, 200, 200]


def test_label_sets_of_works_are_grouped_before_the_driver(spark, monkeypatch):
    """A row for each distinct set of labels, ids numbered by their bytes, not one for each work; and the same incidences."""
    names = ["b", "a", "ä", "Z", "𝄞", "ﬀ"]
    sets = [names[: 1 + i % 3] for i in range(60)] + [["𝄞", "ﬀ", "ä"], ["Z"], []]
    r = bt.backtest(frame(spark, [work(i, labels=s, year=2022) for i, s in enumerate(sets)]), CONCEPT, 2021, 3)
    ids = r.test.labels.select("label_id").orderBy("label_id").toArrow()["label_id"].combine_chunks()
    number = {x: i for i, x in enumerate(ids.to_pylist())}
    lists = permutation.label_lists(r.test.documents, ids)
    assert sorted(lists[2].tolist()) == [1, 1, 20, 20, 20]
    doc, label = permutation.incidences(*lists)
    want = sorted(sorted(number[f"C-{x}"] for x in s) for s in sets if s)
    assert doc.tolist() == [i for i, s in enumerate(want) for _ in s]
    assert label.tolist() == [x for s in want for x in s]
    # What reaches the driver: no row of a work.
    fetched, kind = [], type(spark.range(0))
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(kind, name, lambda df, f=getattr(kind, name): fetched.append(len(rows := f(df))) or rows)
    pairs = spark.createDataFrame([(0, "C-a", "C-b", 3.0)], "place bigint, label_id_a string, label_id_b string, test_expected double")
    scored = spark.createDataFrame([(0, "lift", 1.0)], "place bigint, scorer string, score double")
    permutation.null_aurocs(pairs, scored, r, "co_tagged", 2)
    assert 5 <= max(fetched) < 60


def test_label_sets_of_no_work(spark):
    r = bt.backtest(frame(spark, [work(1, labels="AB", year=2019)]), CONCEPT, 2021, 3)
    ids = r.test.labels.select("label_id").orderBy("label_id").toArrow()["label_id"].combine_chunks()
    assert [len(x) for x in permutation.incidences(*permutation.label_lists(r.test.documents, ids))] == [0, 0]


@pytest.mark.parametrize("name", ["evaluate_above_chance", "wins", "evaluate_co_tagged"])
def test_registered_evaluations_fetch_no_works(spark, monkeypatch, name):
    """Whatever reaches the driver is of labels, pairs and scores: fewer rows than works of the test period."""
    from lacuna.plans import queries as plans

    sets = {2020: ["AB", "AB", "AD", "CB", "CD"], 2022: ["AB", "AC", "CD", "BD", "A"]}
    works = [work(1000 * (year - 2019) + i, labels=s[i % 5], year=year) for year, s in sets.items() for i in range(200)]
    r = bt.backtest(frame(spark, works), CONCEPT, 2021, 3)
    fetched, kind = [], type(spark.range(0))
    for f in ("collect", "toArrow"):
        monkeypatch.setattr(kind, f, lambda df, f=getattr(kind, f): fetched.append(len(rows := f(df))) or rows)
    monkeypatch.setattr(plans, "replay", lambda *a: r)
    monkeypatch.setattr(plans, "PERMUTATIONS", 2)
    out = plans.queries()[name](spark, "").collect()
    assert len(out) == (6 if name == "wins" else 7)
    assert 5 <= max(fetched) < 100


@pytest.mark.parametrize("name", ["evaluate_above_chance", "wins"])
def test_registered_evaluations_fetch_no_sets_of_labels(spark, monkeypatch, name):
    """Works of which no two have the same labels: the driver still gets rows of labels, pairs and scores alone, and the
    workers have every incidence."""
    from itertools import combinations

    from lacuna.operators.evaluate import EVALUATION
    from lacuna.plans import queries as plans

    sets = ["".join(s) for n in (1, 2, 3, 4) for s in combinations("ABCDEFGH", n)]
    r = bt.backtest(frame(spark, [work(1000 * (year - 2019) + i, labels=s, year=year) for year in (2020, 2022) for i, s in enumerate(sets)]), CONCEPT, 2021, 3)
    fetched, kind = [], type(spark.range(0))
    for f in ("collect", "toArrow"):
        monkeypatch.setattr(kind, f, lambda df, f=getattr(kind, f): fetched.append(len(rows := f(df))) or rows)
    monkeypatch.setattr(plans, "replay", lambda *a: r)
    monkeypatch.setattr(plans, "PERMUTATIONS", 2)
    out = plans.queries()[name](spark, "").collect()
    assert len(out) == (6 if name == "wins" else 7)
    assert len(out[0]) == (2 if name == "wins" else len(EVALUATION.split(", ")))
    pairs = r.pairs.where("test_expected >= 3").count()
    assert max(fetched) <= max(len("ABCDEFGH"), 7 * pairs) and len(sets) not in fetched
    ids = r.test.labels.select("label_id").orderBy("label_id").toArrow()["label_id"].combine_chunks()
    doc, label = permutation.incidences(*permutation.read_sets(permutation.label_sets(r.test.documents, ids)))
    got = [tuple(label[doc == i].tolist()) for i in range(len(sets))]
    assert got == sorted(tuple("ABCDEFGH".index(x) for x in s) for s in sets)


def test_swaps_that_share_a_slot_wait_and_pairs_are_counted_in_either_way(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()) for _ in range(300)]
    doc, label = np.repeat(np.arange(300), [len(d) for d in docs]), np.concatenate(docs)
    swapped = plain_shuffle(docs, NULL_SEED)
    monkeypatch.setattr(permutation, "SLOTS", 8)
    out = shuffled(doc, label, NULL_SEED)
    assert out.tolist() == [x for d in swapped for x in d]
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if (a + b) % 3]
    want = [sum(a in d and b in d for d in swapped) for a, b in pairs]
    for codes in (permutation.MAX_CODES, 0):
        monkeypatch.setattr(permutation, "MAX_CODES", codes)
        assert counted(doc, out, 30, np.array([a * 30 + b for a, b in pairs])).tolist() == want


def test_compiled_permutations_are_those_in_arrays(spark, tmp_path):
    """The function of the JVM swaps and counts as ``shuffled`` and ``counted`` do, by either way of counting."""
    rng = np.random.default_rng(7)
    function = permutation.register_permuted_counts(spark)
    for labels, works, most in ((1, 1, 1), (30, 300, 6), (30, 40, 30), (256, 400, 12), (257, 400, 12), (3000, 500, 9)):
        docs = sorted(sorted(rng.choice(labels, rng.integers(1, most + 1), replace=False).tolist()) for _ in range(works))
        sizes = np.array([len(d) for d in docs], np.int32)
        doc, label = np.repeat(np.arange(works), sizes), np.concatenate(docs)
        codes = np.unique([a * labels + b for d in docs for a in d for b in d if a < b] + [labels - 1])
        sets, path = str(tmp_path / f"sets-{labels}-{most}"), str(tmp_path / f"file-{labels}-{most}")
        spark.createDataFrame([(d, 1) for d in docs], "labels array<int>, works int").coalesce(1).write.parquet(sets)
        permutation.write_incidences(sets, path, labels, codes)
        states = [NULL_SEED, jump(NULL_SEED, 2 * permutation.SWEEPS * len(doc)), jump(NULL_SEED, 12345)]
        rows = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(states)], "id int, state bigint").selectExpr("id", f"{function}('file:{path}', state) AS counts").collect()
        for r in rows:
            assert np.frombuffer(r["counts"], "<i4").tolist() == counted(doc, shuffled(doc, label, states[r["id"]]), labels, codes).tolist()


def test_permutations_run_in_the_jvm(spark, monkeypatch):
    """Of a null, the swaps are the compiled function's, and the rows are those of the chain in arrays."""
    sets = {2020: ["AB", "AB", "AD", "CB", "CD"], 2022: ["AB", "AC", "CD", "BD", "A"]}
    r = bt.backtest(frame(spark, [work(1000 * (y - 2019) + i, labels=s[i % 5], year=y) for y, s in sets.items() for i in range(40)]), CONCEPT, 2021, 3)
    ids = ["C-A", "C-B", "C-C", "C-D"]
    lists = permutation.label_lists(r.test.documents, pa.array(ids))
    doc, label = permutation.incidences(*lists)
    codes = np.array([a * 4 + b for a in range(4) for b in range(a + 1, 4)])
    pairs = spark.createDataFrame([(k, ids[c // 4], ids[c % 4], float(k + 5)) for k, c in enumerate(codes.tolist())], "place bigint, label_id_a string, label_id_b string, test_expected double")
    scored = spark.createDataFrame([(k, s, float(k * k % 7)) for k in range(6) for s in permutation.SCORERS], "place bigint, scorer string, score double")
    want = []
    for i in range(5):
        count = counted(doc, shuffled(doc, label, jump(NULL_SEED, i * 2 * permutation.SWEEPS * len(doc))), 4, codes)
        positives = count >= np.arange(6) + 5.0
        table = np.array([k * k % 7 for k in range(6)], float)
        order = np.argsort(table, kind="stable")
        want.append(permutation.midrank_auroc(order, permutation._twice_midranks(table[order]), positives))
    monkeypatch.setattr(permutation, "shuffled", None)
    spark.sparkContext.setJobGroup("null", "")
    got = permutation.null_aurocs(pairs, scored, r, "above_chance", 5)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("null") for s in tracker.getJobInfo(job).stageIds}
    assert sum(1 for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks == 5) == 1  # no permutation twice
    assert [g["jaccard"] for g in got] == [w for w in want if w is not None] and got
