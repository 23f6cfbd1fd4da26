"""Rank statistics over scored, labelled rows, per group: AUROC, precision at k, strata, empirical p.

Groups (scorers) are the unit of parallelism. Within a group everything follows from one row per distinct score, so
windows run over those rows, not over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ties(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score: ``n`` rows and ``p`` positives. Adding zero makes the two zeros one."""
    return scored.withColumn("score", F.col("score") + F.lit(0.0)).groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if("label").alias("p"))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc) of rows (keys, score, label): by mid-ranks; null if a class is missing."""
    ties = _ties(scored, keys)
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Twice the mid-rank is a whole number, so the sum is exact.
    ranks = ties.withColumn("twice", 2 * below + F.col("n") + 1)
    sums = ranks.groupBy(*keys).agg(F.sum(F.col("twice") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*keys, F.try_divide((F.col("r") - p * (p + 1)).cast("double") / 2, F.nullif((p * q).cast("double"), F.lit(0.0))).alias("auroc"))


def precision_at(scored: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """(keys, precision) of rows (keys, k, score, label): the share of positives among the k highest scores.

    Of scores that tie across the cut, each counts the share of the places left; k above the rows means all rows.
    """
    ties = _ties(scored, [*keys, k])
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, k).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = F.least(F.col("n"), F.greatest(F.col(k) - F.col("before"), F.lit(0)))
    got = ties.withColumn("before", before).withColumn("slots", slots)
    return got.groupBy(*keys, k).agg((F.sum(F.col("p") * F.col("slots") / F.col("n")) / F.nullif(F.sum("slots"), F.lit(0)).cast("double")).alias("precision")).drop(k)


def stratum(place: Column, n: Column, bins: int) -> Column:
    """The stratum, from 0 on, of a 0-based place among n rows in bins of sizes that differ by one at most, small ones first."""
    return F.expr("0") + F.floor(((place + 1) * bins - 1) / n).cast("bigint")


def auroc_stratified(scored: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, auroc_stratified) of rows (keys, score, label, place, n): the mean over strata where it is defined, by their rows."""
    dealt = scored.withColumn("stratum", stratum(F.col("place"), F.col("n"), bins))
    each = auroc(dealt, [*keys, "stratum"]).join(dealt.groupBy(*keys, "stratum").agg(F.count("*").alias("rows")), [*keys, "stratum"])
    return each.groupBy(*keys).agg(F.try_divide(F.sum(F.col("auroc") * F.col("rows")), F.sum(F.when(F.col("auroc").isNotNull(), F.col("rows")))).alias("auroc_stratified"))


def empirical_p(observed: float | None, null: list[float]) -> float | None:
    """The two-sided share of null values at least as far from their mean, counting the observed one."""
    if observed is None or not null:
        return None
    mean = sum(null) / len(null)
    far = abs(observed - mean)
    return (1 + sum(abs(x - mean) >= far for x in null)) / (len(null) + 1)
