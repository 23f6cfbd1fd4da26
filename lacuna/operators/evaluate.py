"""Link prediction: seven scorers over evaluable pairs, their rank statistics and a permutation null.

The null of AUROC is not one half here: candidates are chosen by frequency, and both scores and labels follow it.
"""

from __future__ import annotations

from statistics import stdev

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.ranks import auroc, auroc_stratified, empirical_p, precision_at
from lacuna.operators.backtest import Backtest
from lacuna.operators.labels import symmetric
from lacuna.operators.permutation import null_aurocs
from lacuna.params import MIN_EXPECTED, SCORERS, STRATA
from lacuna.session import cut

# The hash of the pseudo-random score.
RANDOM_SEED = 0x6E65747363690001
FNV_PRIME = 0x100000001B3


def pseudo_random(a: str, b: str) -> float:
    """A number in [0, 1) that two ids alone decide."""
    h = RANDOM_SEED
    for byte in f"{a}|{b}".encode():
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return (h >> 11) / (1 << 53)


@F.pandas_udf(T.DoubleType())
def _pseudo_random(a: pd.Series, b: pd.Series) -> pd.Series:
    # The hash multiplies modulo 2^64, which raises an overflow in SQL.
    return pd.Series([pseudo_random(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def evaluable(result: Backtest, positive: str = "co_tagged") -> DataFrame:
    """Pairs whose test expectation reaches the floor, with ``label``."""
    label = F.col("test_observed") > 0 if positive == "co_tagged" else F.coalesce(F.col("test_lift") >= 1, F.lit(False))
    return result.pairs.where(F.col("test_expected") >= MIN_EXPECTED).withColumn("label", label)


def common_neighbors(pairs: DataFrame, result: Backtest) -> DataFrame:
    """``pairs`` with ``common`` neighbours in training, their summed weight ``adamic_adar``, and ``joint`` neighbours.

    The two adjacency lists meet by equi-joins, first one end's neighbours, then the edge to the other end.
    """
    edges = symmetric(result.train.pairs).select("node", F.col("other").alias("z"))
    degree = edges.groupBy(F.col("node")).agg(F.count("*").alias("degree"))
    weight = degree.select(F.col("node").alias("z"), (1.0 / F.ln(F.col("degree"))).alias("w"))  # a common neighbour has two neighbours at least
    a = pairs.select("label_id_a", "label_id_b").join(edges.withColumnRenamed("node", "label_id_a"), "label_id_a")
    both = a.join(edges.withColumnRenamed("node", "label_id_b"), ["label_id_b", "z"]).join(weight, "z")
    # Weights are added in their own order, so the sum does not depend on how rows were dealt.
    summed = F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda s, x: s + x)
    met = both.groupBy("label_id_a", "label_id_b").agg(F.count("*").alias("common"), summed.alias("adamic_adar"))
    out = pairs.join(met, ["label_id_a", "label_id_b"], "left").na.fill({"common": 0, "adamic_adar": 0.0})
    for x in ("a", "b"):
        out = out.join(degree.select(F.col("node").alias(f"label_id_{x}"), F.col("degree").alias(f"degree_{x}")), f"label_id_{x}", "left").na.fill(0, [f"degree_{x}"])
    # Either end's neighbours without the other end; what is common counts once.
    joint = F.col("degree_a") + F.col("degree_b") - 2 * (F.col("observed") > 0).cast("bigint") - F.col("common")
    return out.withColumn("joint", joint)


def scores(pairs: DataFrame, result: Backtest) -> DataFrame:
    """(label_id_a, label_id_b, label, test_expected, scorer, score, ...) in long form, a row per pair and scorer."""
    wide = common_neighbors(pairs, result)
    values = {
        "lift": F.col("lift"),
        "cooccurrence": F.col("observed").cast("double"),
        "preferential_attachment": F.col("works_a").cast("double") * F.col("works_b"),
        "common_neighbors": F.col("common").cast("double"),
        "adamic_adar": F.col("adamic_adar"),
        "jaccard": F.when(F.col("joint") > 0, F.col("common").cast("double") / F.col("joint")).otherwise(F.lit(0.0)),
        "random": _pseudo_random("label_id_a", "label_id_b"),
    }
    wide = wide.select(*pairs.columns, *[v.alias(f"_{k}") for k, v in values.items()])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("scorer"), F.col(f"_{k}").alias("score")) for k in SCORERS])).alias("s")
    return wide.select(*pairs.columns, long).select(*pairs.columns, "s.scorer", "s.score")


def placed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their ``place`` by test expectation, then gap order, and their number ``n``; pairs are a few thousand."""
    order = [F.asc("test_expected"), F.asc("key"), F.desc(F.col("works_a") * F.col("works_b")), "name_a", "name_b", "first_a", "first_b"]
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def evaluate(result: Backtest, positive: str = "co_tagged", top: int = 20, reference: str = "lift", permutations: int = 200) -> DataFrame:
    """One row per scorer in fixed order; ``z`` is the excess over the null in sample deviations of it, null if those are 0."""
    spark = result.pairs.sparkSession
    # A few thousand pairs, read several times.
    pairs = cut(placed(evaluable(result, positive)))
    scored = cut(scores(pairs, result))
    n, positives = pairs.agg(F.count("*"), F.count_if("label")).first()
    k = min(top, n)
    rows = scored.withColumn("k", F.lit(k))
    flipped = rows.select("scorer", "k", (-F.col("score")).alias("score"), (~F.col("label")).alias("label"))
    stats = auroc(scored, ["scorer"]).join(auroc_stratified(scored, ["scorer"], STRATA), "scorer")
    stats = stats.join(precision_at(rows, ["scorer"]).withColumnRenamed("precision", "precision_at_k"), "scorer").join(precision_at(flipped, ["scorer"]).withColumnRenamed("precision", "gap_precision_at_k"), "scorer")
    found = {r["scorer"]: r.asDict() for r in stats.collect()}  # seven rows
    null = null_aurocs(pairs, scored, result, positive, permutations) if permutations and n else []
    used = len(null)
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    out = []
    for scorer in SCORERS:
        f = found.get(scorer, {})
        own = [row[scorer] for row in null]
        base = mean(own)
        seen = f.get("auroc")
        ref = found.get(reference, {}).get("auroc")
        delta = ref - seen if scorer != reference and seen is not None and ref is not None else None
        gaps = [row[reference] - row[scorer] for row in null] if delta is not None else []
        excess = seen - base if seen is not None and base is not None else None
        deviation = stdev(own, base) if len(own) > 1 else None
        z = excess / deviation if excess is not None and deviation else None
        at_k = (f.get("precision_at_k"), f.get("gap_precision_at_k")) if k else (None, None)
        out.append((scorer, n, positives, positives / n if n else None, seen, f.get("auroc_stratified"), base, excess, delta, mean(gaps), empirical_p(delta, gaps), used, k, *at_k, deviation, z))
    return spark.createDataFrame(out, EVALUATION)


EVALUATION = (
    "scorer string, pairs bigint, positives bigint, base_rate double, auroc double, auroc_stratified double, auroc_null double, excess double, "
    "delta double, delta_null double, p_value double, permutations bigint, k bigint, precision_at_k double, gap_precision_at_k double, "
    "auroc_null_sd double, z double"
)
