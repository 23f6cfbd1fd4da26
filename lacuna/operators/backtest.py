"""Candidate pairs of a training period replayed on the later one. Thresholds and candidates come from training alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.gaps import gap_order, gap_pairs, with_observed
from lacuna.operators.labels import LabelGraph, graph_of_documents, label_documents, ranked
from lacuna.params import MIN_EXPECTED, LabelFilter
from lacuna.session import cut, written

# The names of cohorts by training lift, in their order.
BUCKETS = ("train_lift = 0", "train_lift (0, 0.5)", "train_lift [0.5, 1)", "train_lift [1, 2)", "train_lift >= 2")


@dataclass
class Backtest:
    train: LabelGraph
    test: LabelGraph
    pairs: DataFrame
    undated: int


def bucket(observed: Column, product: Column, n: Column) -> Column:
    """The cohort of a pair by its lift, compared in whole numbers (decimals, so products can't overflow)."""
    on = observed.cast("decimal(38,0)") * n
    return F.when(observed == 0, BUCKETS[0]).when(2 * on < product, BUCKETS[1]).when(on < product, BUCKETS[2]).when(on < 2 * product, BUCKETS[3]).otherwise(BUCKETS[4])


def backtest(works: DataFrame, labels: LabelFilter, split_year: int, min_works: int = 15) -> Backtest:
    """Works up to ``split_year`` train, later ones test; works without a year do neither."""
    documents = written(label_documents(works, labels), "labels")
    train, test = graph_of_documents(documents.where(F.col("year") <= split_year)), graph_of_documents(documents.where(F.col("year") > split_year))
    pairs = gap_pairs(train, min_works)
    counts = test.labels.select("label_id", F.col("works").alias("n"))
    for x in ("a", "b"):  # by id, never by place
        of = counts.select(F.col("label_id").alias(f"label_id_{x}"), F.col("n").alias(f"test_works_{x}"))
        pairs = pairs.join(of, f"label_id_{x}", "left").na.fill(0, [f"test_works_{x}"])
    pairs = with_observed(pairs, test.pairs, name="test_observed")
    n = float(test.n_works)
    expected = F.col("test_works_a").cast("double") * F.col("test_works_b") / F.lit(n) if n else F.lit(0.0)
    pairs = pairs.withColumn("test_expected", expected)
    pairs = pairs.withColumn("test_lift", F.when(F.col("test_expected") > 0, F.col("test_observed") / F.col("test_expected")))
    pairs = pairs.withColumn("bucket", bucket(F.col("observed"), F.col("works_a") * F.col("works_b"), F.lit(train.n_works)))
    return Backtest(train, test, cut(pairs), documents.where(F.col("year").isNull()).count())


def top_gaps(result: Backtest, top: int) -> DataFrame:
    """The first ``top`` pairs that never meet in training, with their rank."""
    return ranked(result.pairs.where("observed = 0"), gap_order(), top)


def backtest_rows(result: Backtest, top: int = 20) -> DataFrame:
    cols = [F.col("name_a").alias("concept_a"), F.col("name_b").alias("concept_b"), F.col("works_a").alias("train_works_a"), F.col("works_b").alias("train_works_b"), F.col("expected").alias("train_expected")]
    return top_gaps(result, top).select("rank", *cols, "test_works_a", "test_works_b", "test_observed", "test_expected", "test_lift")


def backtest_summary(result: Backtest, top: int = 20) -> DataFrame:
    """One row per cohort, empty ones too: the top gaps, the lift buckets, and all candidates."""
    pairs = result.pairs
    best = top_gaps(result, top).select("label_id_a", "label_id_b", F.lit(True).alias("best"))
    names = [f"top_{top}_gaps", *BUCKETS, "all_candidates"]
    cohorts = pairs.sparkSession.createDataFrame(list(enumerate(names, 1)), "position bigint, cohort string")
    member = F.array_compact(F.array(F.when(F.col("best"), F.lit(names[0])), F.col("bucket"), F.lit(names[-1])))
    # The best pairs are at most ``top``.
    rows = pairs.join(F.broadcast(best), ["label_id_a", "label_id_b"], "left").select(F.explode(member).alias("cohort"), "test_observed", "test_expected", "test_lift")
    hit, sure = F.col("test_observed") > 0, F.col("test_expected") >= MIN_EXPECTED
    sums = rows.groupBy("cohort").agg(
        F.count("*").alias("pairs"), F.count_if(hit).alias("hits"), F.count_if(sure).alias("evaluable"), F.count_if(hit & sure).alias("evaluable_hits"),
        F.median("test_expected").alias("median_test_expected"), F.median("test_lift").alias("median_test_lift"),
    )
    out = cohorts.join(sums, "cohort", "left")
    out = out.na.fill(0, ["pairs", "hits", "evaluable", "evaluable_hits"])
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.select("position", "cohort", "pairs", "hits", rate("hits", "pairs").alias("hit_rate"), "evaluable", "evaluable_hits", rate("evaluable_hits", "evaluable").alias("evaluable_hit_rate"), "median_test_expected", "median_test_lift").orderBy("position")


def split_year(works: DataFrame) -> DataFrame:
    """(year, works, share): the first year up to which at least half of the dated works appeared. One row per year."""
    from pyspark.sql import Window

    years = works.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("works"))
    share = F.sum("works").over(Window.orderBy("year")) / F.sum("works").over(Window.partitionBy())
    return years.withColumn("share", share).where("share >= 0.5").orderBy("year").limit(1)
