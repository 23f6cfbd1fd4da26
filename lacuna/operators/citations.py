"""The citation graph inside a corpus, PageRank, and the corpus's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lacuna.functions.text import truncated
from lacuna.operators.labels import incidence, ranked
from lacuna.params import CONCEPTS, DAMPING, MAX_ITERATIONS, TOLERANCE, TOPICS, LabelFilter
from lacuna.session import cut

RANK_DIGITS = 12


def nodes(works: DataFrame) -> DataFrame:
    """(id, first): each id once, with the place of the first work that has it."""
    return works.groupBy("id").agg(F.min("ord").alias("first"))


def references(works: DataFrame) -> DataFrame:
    """(src, dst): distinct references of each id, itself left out; ids outside the corpus too."""
    return works.select(F.col("id").alias("src"), F.explode("referenced_works").alias("dst")).where("src <> dst").distinct()


def citation_edges(works: DataFrame) -> DataFrame:
    """(src, dst) of references to works of the corpus."""
    return references(works).join(works.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def in_degree(works: DataFrame) -> DataFrame:
    """(id, in_corpus_citations) of every id."""
    cited = citation_edges(works).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes(works).select("id").join(cited, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("in_corpus_citations"))


def pagerank(ids: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> DataFrame:
    """(id, pagerank) of all ``ids`` (id) over distinct ``edges`` (src, dst).

    The rank of ids without edges out is spread over all. Ends once the ranks move by less than ``tolerance`` in
    all, or after ``most`` rounds. A round is one job: a join of the edges with the ranks, one aggregation by target, and
    a checkpoint, without which plans would double from round to round; how far ranks moved and what leads nowhere is
    observed on the way. Edges are dealt by source once and stay so.
    """
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("pagerank")).limit(0)
    # A fixed number of partitions, so that edges and ranks stay dealt alike from round to round.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(edges.repartition(tasks, "src"))
    degree = cut(dealt.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out")))
    weighted = cut(dealt.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (1.0 / F.col("out")).alias("w")))
    ranks = cut(ids.join(degree, "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")).repartition(tasks, "id"))
    lost = ranks.where("dangling").count() / n
    for _ in range(most):
        given = ranks.select(F.col("id").alias("src"), "rank").join(weighted, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("given"))
        now = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("given", F.lit(0.0))
        seen = Observation()
        fresh = ranks.join(given, "id", "left").select("id", "dangling", now.alias("rank"), F.abs(now - F.col("rank")).alias("moved"))
        stray = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
        ranks = cut(fresh.observe(seen, F.sum("moved").alias("moved"), stray.alias("lost"))).drop("moved")
        lost = seen.get["lost"]
        if seen.get["moved"] < tolerance:
            break
    return ranks.select("id", F.col("rank").alias("pagerank"))


def top_cited(works: DataFrame, top: int = 20) -> DataFrame:
    """(rank, id, title, year, pagerank, in_corpus_citations, cited_by_count) by PageRank, citations, id.

    Ranks that differ in the last places of a sum alone count as equal, as sums are added in any order.
    """
    edges = citation_edges(works)
    first = works.groupBy("id").agg(F.min_by(F.struct("title", "year", "cited_by_count"), "ord").alias("w"))
    ranks = pagerank(nodes(works).select("id"), edges)
    best = ranked(ranks.join(in_degree(works), "id"), [F.desc(F.round("pagerank", RANK_DIGITS)), F.desc("in_corpus_citations"), F.asc("id")], top)
    # At most ``top`` rows meet the works.
    rows = first.join(F.broadcast(best), "id")
    return rows.select("rank", "id", truncated(F.coalesce("w.title", F.lit(""))).alias("title"), "w.year", "pagerank", "in_corpus_citations", "w.cited_by_count")


def stats(works: DataFrame) -> DataFrame:
    """One row of figures. Labels are counted with the default filter; ``works`` counts ids, ``abstracts`` rows."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    labels = lambda kind: count(incidence(works, LabelFilter(kind)).select("label_id").distinct(), kind)
    rows = works.agg(F.count_distinct("id").alias("works"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("abstract").alias("abstracts"))
    one = rows
    for part in (count(citation_edges(works), "internal_edges"), count(references(works), "total_references"), labels(TOPICS), labels(CONCEPTS)):
        one = one.crossJoin(F.broadcast(part))  # one row each
    share = F.when(F.col("total_references") > 0, F.col("internal_edges") / F.col("total_references")).otherwise(F.lit(0.0))
    return one.select("works", "year_min", "year_max", "internal_edges", "total_references", share.alias("internal_ratio"), "topics", "concepts", "abstracts")
