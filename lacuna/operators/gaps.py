"""Label pairs that co-occur less than independence predicts, and labels that bridge them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.labels import LabelGraph, ranked, symmetric
from lacuna.params import MIN_BRIDGE_OBSERVED, MIN_EXPECTED

#: Labels that are broadcast for pairing, at most; more are paired by ranges of their frequency.
BROADCAST_LABELS = 200_000
#: Labels in a part of a range, about.
PART_LABELS = 20_000


def ratio(observed, wa, wb):
    """Observed over the product of frequencies: one division of whole numbers, which orders as the exact ratio does
    while numerator times denominator stays below 2^53; beyond that ratios that differ in the last bit may tie."""
    return observed.cast("double") / (wa.cast("double") * wb.cast("double"))


def candidate_pairs(labels: DataFrame, n_works: int, min_works: int) -> DataFrame:
    """All pairs of labels with at least ``min_works`` works whose expected count reaches the floor.

    A pair is oriented by (name, first place). A floor on the product of two frequencies is a floor on each given the
    larger one, so labels too rare to reach it with the most frequent label never enter the pairing.
    """
    kept = labels.where(F.col("works") >= min_works)
    most, n = kept.agg(F.max("works"), F.count("*")).first()
    floor = MIN_EXPECTED * n_works
    kept = kept.where(F.col("works") * F.lit(most or 0) >= floor)
    side = lambda x: kept.select(*[F.col(c).alias(f"{c}_{x}") for c in ("label_id", "name", "works", "first")])
    oriented = F.struct("name_a", "first_a") < F.struct("name_b", "first_b")
    wanted = oriented & (F.col("works_a") * F.col("works_b") >= floor)
    if n <= BROADCAST_LABELS:
        return side("a").join(F.broadcast(side("b")), wanted)
    return _paired_by_range(kept, side, wanted, floor)


def _paired_by_range(kept: DataFrame, side, wanted, floor: int) -> DataFrame:
    """Labels are cut into ranges of frequency, by powers of two, and large ranges into parts. Two parts are paired, as
    one key of a join, only if the largest product of their ranges reaches the floor."""
    power = lambda c: F.floor(F.log2(c.cast("double")) + 1e-9).cast("int")
    sizes = kept.groupBy(power(F.col("works")).alias("power")).count().collect()  # one row a range, 63 at most
    parts = [(r["power"], p, -(-r["count"] // PART_LABELS)) for r in sizes for p in range(-(-r["count"] // PART_LABELS))]
    met = [(i, *x, *y) for i, (x, y) in enumerate((x, y) for x in parts for y in parts if 2 ** (x[0] + y[0] + 2) >= floor)]
    units = kept.sparkSession.createDataFrame(met, "unit int, power_a int, part_a int, parts_a int, power_b int, part_b int, parts_b int")

    def dealt(x):
        where = (power(F.col(f"works_{x}")) == F.col(f"power_{x}")) & (F.pmod(F.xxhash64(f"label_id_{x}"), F.col(f"parts_{x}")) == F.col(f"part_{x}"))
        mine = units.select("unit", f"power_{x}", f"part_{x}", f"parts_{x}")
        # As many rows as pairs of parts: (labels / PART_LABELS + 63) squared at most.
        return side(x).join(F.broadcast(mine), where).drop(f"power_{x}", f"part_{x}", f"parts_{x}")

    return dealt("a").join(dealt("b").hint("shuffle_hash"), "unit").where(wanted).drop("unit")


def with_observed(pairs: DataFrame, counts: DataFrame, a: str = "label_id_a", b: str = "label_id_b", name: str = "observed") -> DataFrame:
    """``pairs`` with their count, 0 if there is none; keys are met whichever way round they stand."""
    keyed = counts.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("observed").alias("_n"))
    met = pairs.join(keyed, (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left")
    return met.withColumn(name, F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_a", "_b", "_n")


def gap_pairs(graph: LabelGraph, min_works: int) -> DataFrame:
    """Every candidate pair with observed, expected, lift and its exact order ``key``."""
    pairs = with_observed(candidate_pairs(graph.labels, graph.n_works, min_works), graph.pairs)
    wa, wb = F.col("works_a"), F.col("works_b")
    pairs = pairs.withColumn("expected", wa.cast("double") * wb / F.lit(float(graph.n_works)))
    return pairs.withColumn("lift", F.col("observed") / F.col("expected")).withColumn("key", ratio(F.col("observed"), wa, wb))


def gap_order() -> list:
    """Lift upwards by exact ratio, expected downwards, names, first places."""
    return [F.asc("key"), F.desc(F.col("works_a") * F.col("works_b")), F.asc("name_a"), F.asc("name_b"), F.asc("first_a"), F.asc("first_b")]


def find_gaps(graph: LabelGraph, min_works: int = 15, top: int = 20) -> DataFrame:
    """The ``top`` gap pairs with their rank."""
    return ranked(gap_pairs(graph, min_works), gap_order(), top)


def gap_rows(gaps: DataFrame) -> DataFrame:
    return gaps.select("rank", F.col("name_a").alias("concept_a"), F.col("name_b").alias("concept_b"), "works_a", "works_b", "observed", "expected", "lift")


def find_bridges(graph: LabelGraph, gaps: DataFrame, min_works: int, per_pair: int) -> DataFrame:
    """(rank, bridge, observed_a, observed_c, place) of labels that co-occur with either side of a gap more than chance.

    Edges that may serve are chosen first; then two equi-joins, never every label against every pair.
    """
    names = graph.labels.select("label_id", "name", "works", "first")
    bridge = names.where(F.col("works") >= min_works).select(F.col("label_id").alias("other"), F.col("name").alias("bridge"), F.col("works").alias("bridge_works"), F.col("first").alias("bridge_first"))
    ends = names.select(F.col("label_id").alias("node"), F.col("works").alias("node_works"))
    edges = symmetric(graph.pairs.where(F.col("observed") >= MIN_BRIDGE_OBSERVED)).join(bridge, "other").join(ends, "node")
    edges = edges.where(F.col("observed") * F.lit(graph.n_works) > F.col("node_works") * F.col("bridge_works"))
    edges = edges.withColumn("ratio", ratio(F.col("observed"), F.col("node_works"), F.col("bridge_works")))
    of = lambda end, tag: edges.select(F.col("node").alias(f"label_id_{end}"), F.col("other").alias("_b"), F.col("observed").alias(f"observed_{tag}"), F.col("ratio").alias(f"ratio_{tag}"))
    left = of("a", "a").join(bridge.select(F.col("other").alias("_b"), "bridge", "bridge_first"), "_b")
    # Gaps are at most ``top`` rows.
    met = F.broadcast(gaps.select("rank", "label_id_a", "label_id_b")).join(left, "label_id_a").join(of("b", "c"), ["label_id_b", "_b"])
    met = met.where((F.col("_b") != F.col("label_id_a")) & (F.col("_b") != F.col("label_id_b")))
    order = Window.partitionBy("rank").orderBy(F.desc(F.least("ratio_a", "ratio_c")), F.desc(F.least("observed_a", "observed_c")), F.asc("bridge"), F.asc("bridge_first"))
    return met.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= per_pair).select("rank", "bridge", "observed_a", "observed_c", "place")


def gaps_with_bridges(graph: LabelGraph, min_works: int, top: int, per_pair: int) -> DataFrame:
    """Gap rows with a cell of bridges: ``B (with A|with C); ...``."""
    gaps = find_gaps(graph, min_works, top)
    found = find_bridges(graph, gaps, min_works, per_pair)
    said = F.concat(F.col("bridge"), F.lit(" ("), F.col("observed_a").cast("string"), F.lit("|"), F.col("observed_c").cast("string"), F.lit(")"))
    # At most ``per_pair`` rows a pair.
    cells = found.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]), "; ").alias("bridges"))
    return gap_rows(gaps).join(cells, "rank", "left").na.fill({"bridges": ""})
