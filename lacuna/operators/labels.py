"""Labels of works and their co-occurrence graph.

Labels are filtered, de-duplicated and paired inside each work's own array, so the only shuffles are the two
aggregations, by label and by pair, and both combine on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.arrays import let
from lacuna.params import CONCEPTS, LabelFilter
from lacuna.session import cut, written


def label_documents(works: DataFrame, labels: LabelFilter) -> DataFrame:
    """(ord, year, labels) of every work, labels or none: those that pass, the first of each id."""
    tags = F.col(labels.taxonomy)
    level = (lambda t: t["level"]) if labels.taxonomy == CONCEPTS else (lambda t: F.lit(None).cast("int"))
    passes = lambda t: (t["score"] >= labels.min_score) & ((t["level"] >= labels.min_level) if labels.taxonomy == CONCEPTS else F.lit(True))
    # Predicates stand before the explode, as they aren't pushed through it.
    kept = F.filter(F.transform(tags, lambda t, i: F.struct(i.alias("pos"), t["id"].alias("label_id"), t["name"].alias("name"), level(t).alias("level"), passes(t).alias("ok"))), lambda t: t["ok"])
    first = lambda a: let(F.transform(a, lambda u: u["label_id"]), lambda ids: F.filter(a, lambda t, i: F.array_position(ids, t["label_id"]) == i + 1))
    return works.select("ord", "year", kept.alias("_kept")).select("ord", "year", first(F.col("_kept")).alias("labels"))


def incidence(works: DataFrame, labels: LabelFilter) -> DataFrame:
    """(ord, year, label_id, name, level, pos): one row per work and distinct label."""
    return label_documents(works, labels).select("ord", "year", F.explode("labels").alias("l")).select("ord", "year", "l.label_id", "l.name", "l.level", "l.pos")


def label_table(documents: DataFrame) -> DataFrame:
    """(label_id, name, level, works, first): name, level and place are those of the first work that has the label."""
    rows = documents.select("ord", F.explode("labels").alias("l"))
    at = F.struct("ord", "l.pos")
    return rows.groupBy(F.col("l.label_id").alias("label_id")).agg(F.min_by("l.name", at).alias("name"), F.min_by("l.level", at).alias("level"), F.count("*").alias("works"), F.min(at).alias("first"))


def pairs_of(ids) -> F.Column:
    """All (a, b) with a < b of an array of distinct ids."""
    return let(F.array_sort(ids), lambda o: F.flatten(F.transform(o, lambda x, i: F.transform(F.slice(o, i + 2, F.size(o)), lambda y: F.struct(x.alias("a"), y.alias("b"))))))


def cooccurrence(documents: DataFrame) -> DataFrame:
    """(a, b, observed) of label pairs with a < b that some work has."""
    ids = F.transform("labels", lambda l: l["label_id"])  # noqa: E741
    return documents.where(F.size("labels") > 1).select(F.explode(pairs_of(ids)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("observed"))


@dataclass
class LabelGraph:
    """``n_works`` counts all works, those without labels and repeated ids too.

    The labels of all works are written once, without the rest of the works, so the corpus is read once. Labels and
    pairs are aggregates of those, far smaller, and everything else is made of them; they are checkpointed.
    """

    n_works: int
    documents: DataFrame
    labels: DataFrame
    pairs: DataFrame


def label_graph(works: DataFrame, labels: LabelFilter) -> LabelGraph:
    return graph_of_documents(written(label_documents(works, labels), "labels"))


def graph_of_documents(documents: DataFrame) -> LabelGraph:
    """The graph of works (ord, year, labels) that are written already."""
    return LabelGraph(documents.count(), documents, cut(label_table(documents)), cut(cooccurrence(documents)))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(node, other, observed): each pair both ways."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "observed"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "observed"))).alias("e")).select("e.*")


def neighbours(graph: LabelGraph) -> DataFrame:
    """(label_id, name, level, works, first, strength, degree, top_neighbor) of every label.

    The top neighbour has the largest weight, then the least name, then the least id; null if there is none.
    """
    names = graph.labels.select(F.col("label_id").alias("other"), F.col("name").alias("other_name"))
    edges = symmetric(graph.pairs).join(names, "other")
    best = edges.groupBy(F.col("node").alias("label_id")).agg(F.sum("observed").alias("strength"), F.count("*").alias("degree"), F.min_by("other_name", F.struct(-F.col("observed"), "other_name", "other")).alias("top_neighbor"))
    return graph.labels.join(best, "label_id", "left").na.fill({"strength": 0, "degree": 0})


def ranked(df: DataFrame, order: list, top: int, rank: str = "rank") -> DataFrame:
    """The first ``top`` rows by a total order with their place; a top-k, so only these rows meet in one task."""
    from pyspark.sql import Window

    first = df.orderBy(*order).limit(top)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_labels(graph: LabelGraph, top: int) -> DataFrame:
    """(rank, concept, level, works, strength, top_neighbor) by strength, works, name, first work."""
    order = [F.desc("strength"), F.desc("works"), F.asc("name"), F.asc("first")]
    return ranked(neighbours(graph), order, top).select("rank", F.col("name").alias("concept"), "level", "works", "strength", "top_neighbor")
