"""The registered queries of the analyses, over the adapter corpora."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.ranks import auroc, auroc_stratified, precision_at
from lacuna.functions.text import label_term, normalise, snippet_udf, terms_of, truncated
from lacuna.operators import backtest as bt
from lacuna.operators import citations as ct
from lacuna.operators import derived
from lacuna.operators.evaluate import evaluable, evaluate, placed, scores
from lacuna.operators.gaps import find_bridges, find_gaps, gap_pairs, gap_rows, gaps_with_bridges
from lacuna.operators.labels import cooccurrence, incidence, label_documents, label_graph, label_table, neighbours, top_labels
from lacuna.operators.textcheck import evidence, text_hits, texts, verify_gaps
from lacuna.params import CONCEPTS, STRATA, TOPICS, LabelFilter
from lacuna.session import cut, shared_dir
from lacuna.sources.adapters import basket_works, document_works, part_edges, read
from lacuna.sources.corpus import abstract_of, bare_id, normalise_pages, number_rows, read_works, truncate_dedup, write_works
from lacuna.sources.schema import ID_PREFIX, PAGE, WORKS

#: Brand and type of parts, any level; the names of parts; words of documents.
BRANDS, NAMES, WORDS = LabelFilter(CONCEPTS, 0, 0.4), LabelFilter(TOPICS), LabelFilter(CONCEPTS, 2, 0.4)
SPLIT, TOP = 1998, 20
#: As many as the reference draws; p below 0.05 takes 20 at least.
PERMUTATIONS = 200
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def graph_of(spark, d, labels=BRANDS):
    return label_graph(basket_works(spark, d), labels)


def replay(spark, d, labels=BRANDS) -> bt.Backtest:
    return bt.backtest(basket_works(spark, d), labels, SPLIT)


@query
def scan_works(spark, d):
    w = basket_works(spark, d, references=True)
    return w.select("ord", "id", "title", "year", "cited_by_count", F.size("referenced_works").cast("bigint").alias("n_refs"), F.size("concepts").cast("bigint").alias("n_concepts"), F.size("topics").cast("bigint").alias("n_topics"))


@query
def normalize_ids(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(ID_PREFIX + "W"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("W"), F.col("o_orderkey").cast("string"))).alias("raw"))
    return ids.select("o_orderkey", bare_id(F.col("raw")).alias("id"))


@query
def dedup_works(spark, d):
    """Orders of one customer and year under one id: the first of each stays."""
    o = read(spark, d, "orders")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in WORKS.fields}
    rows = o.select(F.col("o_orderkey").cast("bigint").alias("ord"), F.concat_ws("-", F.lit("C"), F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("id"), *[none[f] for f in WORKS.fieldNames()[2:]])
    return truncate_dedup(rows, None).select("ord", "id")


@query
def abstracts(spark, d):
    """The texts' words as inverted indexes, and the texts made of those again."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    at = read(spark, d, "documents").select("doc_id", F.posexplode(words).alias("p", "w"))
    lists = at.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list(F.col("p").cast("bigint"))).alias("ps"))  # places of one word in one document
    index = lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", F.sha2(abstract_of(F.col("index")), 256).alias("digest"))


@query
def jsonl_round_trip(spark, d):
    """Works written as JSON lines and read back with the checked schema."""
    path = f"{shared_dir(spark)}/works-{uuid.uuid4().hex}"
    write_works(basket_works(spark, d, references=True), path)
    w = read_works(spark, path)
    return w.select("ord", "id", "title", "year", "cited_by_count", F.size("referenced_works").cast("bigint").alias("n_refs"), F.size("concepts").cast("bigint").alias("n_concepts"), F.size("topics").cast("bigint").alias("n_topics"))


@query
def api_pages(spark, d):
    """Orders as pages of an API, two hundred keys a page: every tenth without an id, every third without citations."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    index = F.map_from_arrays(F.array(F.lit("order"), F.concat(F.lit("no"), key.cast("string"))), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    result = F.struct(
        F.when(key % 10 != 0, F.concat(F.lit(ID_PREFIX + "W"), key.cast("string"))).alias("id"), F.concat(F.lit("Order "), key.cast("string")).alias("display_name"), F.year("o_orderdate").alias("publication_year"),
        F.when(key % 3 != 0, F.floor("o_totalprice")).alias("cited_by_count"), F.array(F.concat(F.lit(ID_PREFIX + "W"), (key - 1).cast("string"))).alias("referenced_works"), index.alias("abstract_inverted_index"),
    )
    lists = o.groupBy(F.expr("cast(o_orderkey div 200 as int)").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), result.alias("r"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["r"]).alias("results"))  # a page
    bodies = lists.select("page", F.from_json(F.to_json(F.struct("results")), PAGE).alias("b")).select("page", "b.*")
    works = truncate_dedup(number_rows(normalise_pages(bodies)), None)
    return works.select("ord", "id", "title", "year", "cited_by_count", F.element_at("referenced_works", 1).alias("ref"), F.size("concepts").cast("bigint").alias("n_concepts"), "abstract")


@query
def snippets(spark, d):
    """What stands around a word in the documents' texts, cut by bytes."""
    t = texts(document_works(spark, d))
    return t.select("ord", snippet_udf([" that ", " with "])("text").alias("snippet"))


@query
def label_incidence(spark, d):
    return incidence(basket_works(spark, d), BRANDS).select("ord", "label_id", "level", F.col("pos").cast("bigint").alias("pos"))


@query
def label_incidence_topics(spark, d):
    return incidence(basket_works(spark, d), NAMES).select("ord", "label_id", F.col("pos").cast("bigint").alias("pos"))


@query
def label_filter_level(spark, d):
    return incidence(basket_works(spark, d), LabelFilter(CONCEPTS, 2, 0.4)).groupBy("label_id").agg(F.count("*").alias("works"))


@query
def label_frequency(spark, d):
    t = label_table(label_documents(basket_works(spark, d), BRANDS))
    return t.select("label_id", "name", "level", "works", F.col("first.ord").alias("first_ord"))


@query
def cooccurrence_pairs(spark, d):
    return cooccurrence(label_documents(basket_works(spark, d), BRANDS))


@query
def label_strength(spark, d):
    return neighbours(graph_of(spark, d)).select("label_id", "strength", "degree")


@query
def top_neighbor(spark, d):
    return neighbours(graph_of(spark, d)).select("label_id", "top_neighbor")


@query
def concepts_top(spark, d):
    return top_labels(graph_of(spark, d), TOP)


@query
def topics_top(spark, d):
    return top_labels(graph_of(spark, d, NAMES), TOP)


@query
def stats(spark, d):
    return ct.stats(basket_works(spark, d, references=True))


@query
def citation_edges(spark, d):
    return ct.citation_edges(basket_works(spark, d, references=True))


@query
def in_degree(spark, d):
    return ct.in_degree(basket_works(spark, d, references=True))


def yearly_works(spark, d) -> DataFrame:
    """Orders as works that share the id of their customer and year. Each refers to itself, twice to the year before,
    which may be outside the corpus, and to an id that no work has; every third has an abstract."""
    o = read(spark, d, "orders")
    name = lambda year: F.concat_ws("-", F.lit("C"), F.col("o_custkey").cast("string"), year.cast("string"))
    year, none = F.year("o_orderdate"), {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in WORKS.fields}
    refs = F.array(name(year), name(year - 1), F.concat(F.lit("X"), F.col("o_orderkey").cast("string")), name(year - 1))
    own = {"ord": F.col("o_orderkey").cast("bigint"), "id": name(year), "year": year, "referenced_works": refs, "abstract": F.when(F.col("o_orderkey") % 3 == 0, F.lit("text"))}
    return o.select(*[own[f].alias(f) if f in own else none[f] for f in WORKS.fieldNames()])


@query
def citation_edges_yearly(spark, d):
    """Edges where ids repeat and references go outside, to the work itself, or come twice."""
    return ct.citation_edges(yearly_works(spark, d))


@query
def in_degree_yearly(spark, d):
    return ct.in_degree(yearly_works(spark, d))


@query
def stats_yearly(spark, d):
    return rounded(ct.stats(yearly_works(spark, d)), "internal_ratio", digits=9)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def pagerank_orders(spark, d):
    w = basket_works(spark, d, references=True)
    return rounded(ct.pagerank(ct.nodes(w).select("id"), ct.citation_edges(w)), "pagerank", digits=9)


@query
def pagerank_parts(spark, d):
    edges = part_edges(spark, d)
    ids = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return rounded(ct.pagerank(ids, edges), "pagerank", digits=8)


@query
def citations_top(spark, d):
    return rounded(ct.top_cited(basket_works(spark, d, references=True), TOP), "pagerank", digits=9)


@query
def gaps_top(spark, d):
    return gap_rows(find_gaps(graph_of(spark, d), top=TOP))


@query
def gaps_topics_top(spark, d):
    return gap_rows(find_gaps(graph_of(spark, d, NAMES), top=TOP))


@query
def gaps_all(spark, d):
    return gap_pairs(graph_of(spark, d), 15).select("label_id_a", "label_id_b", "works_a", "works_b", "observed", "expected", "lift")


@query
def gaps_min_level(spark, d):
    return gap_rows(find_gaps(graph_of(spark, d, LabelFilter(CONCEPTS, 2, 0.4)), 5, TOP))


@query
def bridges(spark, d):
    graph = graph_of(spark, d)
    return find_bridges(graph, cut(find_gaps(graph, top=TOP)), 15, 3)


@query
def gaps_bridged(spark, d):
    return gaps_with_bridges(graph_of(spark, d), 15, TOP, 3)


@query
def text_normalize(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.sha2(normalise(F.col("text")), 256).alias("digest"), F.char_length(normalise(F.col("text"))).cast("bigint").alias("n"))


@query
def label_terms(spark, d):
    """The phrases of part names with a qualifier in brackets."""
    return read(spark, d, "part").select("p_partkey", label_term(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("term"))


@query
def title_cut(spark, d):
    return read(spark, d, "documents").select("doc_id", truncated(F.col("text")).alias("title"))


def word_graph(spark, d):
    """Documents as works, and their graph. The texts are read again where they are needed, not copied."""
    works = document_works(spark, d)
    return works, label_graph(works, WORDS)


#: Labels whose phrases are of several words, one with a qualifier, and phrases that stand for labels too.
PHRASES = (("en", "Of the (grammar)"), ("de", "und der"), ("fr", "de la"), ("one", "that"))
PHRASE_ALIASES = (("of the (GRAMMAR)", "to the"), ("That", "is to"), ("that", "and  a"), ("nobody", "of"))
#: Aliases of words that are labels of the documents.
WORD_ALIASES = (("THAT", "of the"), ("with", "in the"), ("pour", "de la"))


@query
def text_hits_phrases(spark, d):
    """Documents in which a phrase or an alias of a label stands."""
    labels = spark.createDataFrame(list(PHRASES), "label_id string, name string")
    hits = text_hits(texts(document_works(spark, d)), terms_of(labels, list(PHRASE_ALIASES)))
    return hits.groupBy("label_id").agg(F.count("*").alias("works"))


@query
def verify_aliases(spark, d):
    """The top gaps checked with aliases, some of two words."""
    works, graph = word_graph(spark, d)
    return verify_gaps(works, graph, 5, TOP, list(WORD_ALIASES))


@query
def text_hits_words(spark, d):
    works, graph = word_graph(spark, d)
    labels = graph.labels.where("works >= 5").select("label_id", label_term(F.col("name")).alias("term"))
    return text_hits(texts(works), labels).groupBy("label_id").agg(F.count("*").alias("works"))


@query
def verify_top(spark, d):
    works, graph = word_graph(spark, d)
    return verify_gaps(works, graph, 5, TOP)


#: Two words for a sample of evidence, in either language of the documents' inventions.
EVIDENCE = ("that", "with")


@query
def evidence_sample(spark, d):
    works = cut(document_works(spark, d))
    return evidence(works, WORDS, *EVIDENCE, limit=10).select("rank", "id", "year", "tag_a", "tag_b", "total", "url")


@query
def backtest_pairs(spark, d):
    return replay(spark, d).pairs.select("label_id_a", "label_id_b", "works_a", "works_b", "observed", "expected", "test_works_a", "test_works_b", "test_observed", "test_expected", "test_lift")


@query
def backtest_top(spark, d):
    return bt.backtest_rows(replay(spark, d), TOP)


@query
def backtest_summary(spark, d):
    return rounded(bt.backtest_summary(replay(spark, d), TOP), "median_test_expected", "median_test_lift")


@query
def lift_bucket(spark, d):
    return replay(spark, d).pairs.groupBy("bucket").agg(F.count("*").alias("pairs"))


@query
def evaluable_pairs(spark, d):
    return evaluable(replay(spark, d), "above_chance").select("label_id_a", "label_id_b", "label")


def _scores(spark, d, scorer):
    result = replay(spark, d)
    s = scores(evaluable(result), result).where(F.col("scorer") == scorer)
    return rounded(s.select("label_id_a", "label_id_b", "score"), "score", digits=9)


for _name, _scorer in (("scorer_lift", "lift"), ("scorer_cooccurrence", "cooccurrence"), ("scorer_pref_attach", "preferential_attachment"), ("scorer_common_neighbors", "common_neighbors"), ("scorer_adamic_adar", "adamic_adar"), ("scorer_jaccard", "jaccard"), ("scorer_random", "random")):
    _QUERIES[_name] = partial(_scores, scorer=_scorer)


def _scored(spark, d):
    """Scores of evaluable pairs without the pseudo-random one; ``evaluate_scorers`` has all of them."""
    result = replay(spark, d)
    return scores(cut(placed(evaluable(result))), result).where("scorer <> 'random'")


@query
def auroc_by_scorer(spark, d):
    return rounded(auroc(_scored(spark, d), ["scorer"]), "auroc")


@query
def auroc_strata(spark, d):
    return rounded(auroc_stratified(_scored(spark, d), ["scorer"], STRATA), "auroc_stratified")


@query
def precision_at_k(spark, d):
    return rounded(precision_at(_scored(spark, d).withColumn("k", F.lit(TOP)), ["scorer"]), "precision")


@query
def gap_precision_at_k(spark, d):
    flipped = _scored(spark, d).select("scorer", F.lit(TOP).alias("k"), (-F.col("score")).alias("score"), (~F.col("label")).alias("label"))
    return rounded(precision_at(flipped, ["scorer"]), "precision")


_MEASURES = ("base_rate", "auroc", "auroc_stratified", "delta", "precision_at_k", "gap_precision_at_k")


@query
def evaluate_scorers(spark, d):
    """The evaluation of all scorers without its null."""
    return rounded(evaluate(replay(spark, d), "co_tagged", TOP, permutations=0), *_MEASURES).select("scorer", "pairs", "positives", *_MEASURES, "permutations", "k")


@query
def evaluate_scorers_above_chance(spark, d):
    return rounded(evaluate(replay(spark, d), "above_chance", TOP, permutations=0), *_MEASURES).select("scorer", "pairs", "positives", *_MEASURES, "permutations", "k")


@query
def evaluate_co_tagged(spark, d):
    return evaluate(replay(spark, d), "co_tagged", TOP, permutations=PERMUTATIONS)


@query
def evaluate_above_chance(spark, d):
    return evaluate(replay(spark, d), "above_chance", TOP, permutations=PERMUTATIONS)


@query
def split_year_rule(spark, d):
    return rounded(bt.split_year(basket_works(spark, d)), "share")


@query
def poisson_expected_zeros(spark, d):
    return rounded(derived.poisson_zeros(gap_pairs(graph_of(spark, d), 15)), "expected_zeros", digits=4)


@query
def spearman_tag_vs_text(spark, d):
    works, graph = word_graph(spark, d)
    return rounded(derived.rank_correlation(verify_gaps(works, graph, 5, None).withColumn("tag_lift", F.col("tag_observed") / F.col("expected")), "tag_lift", "text_lift"), "rho")


@query
def verify_by_bucket(spark, d):
    works, graph = word_graph(spark, d)
    return derived.verdicts_by_lift(verify_gaps(works, graph, 5, None))


@query
def corpus_diff(spark, d):
    """Gap pairs of the two halves of the orders, met by the labels' names."""
    works = basket_works(spark, d)
    one = gap_pairs(label_graph(works.where("ord % 2 = 0"), BRANDS), 15)
    two = gap_pairs(label_graph(works.where("ord % 2 = 1"), BRANDS), 15)
    return derived.compare_gaps(one, two)


@query
def wins(spark, d):
    """Which scorers differ from the reference by the paired test."""
    return derived.wins(evaluate(replay(spark, d), "co_tagged", TOP, permutations=PERMUTATIONS))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
