"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from lacuna.params import SNIPPET_RADIUS as RADIUS

SPLIT, TOP = 1998, 20
_ID = "https://openalex.org/"

# Lines of orders with their labels, in their order within the order.
BASE = """base AS MATERIALIZED (
  SELECT o_orderkey AS ord, year(o_orderdate) AS year, p_brand || '/' || p_type AS cid, p_name AS tid, CAST(p_size // 10 AS INTEGER) AS level, l_quantity AS q,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
works AS MATERIALIZED (SELECT o_orderkey AS ord, year(o_orderdate) AS year FROM orders)"""


def inc(name: str = "inc", label: str = "cid", min_level: int = 0, where: str = "true") -> str:
    level = "level" if label == "cid" else "CAST(NULL AS INTEGER)"
    cond = f"level >= {min_level} AND" if label == "cid" else ""
    return f"""{name} AS MATERIALIZED (SELECT ord, any_value(year) AS year, {label} AS label_id, min(pos) AS pos, arg_min({level}, pos) AS level
  FROM base WHERE {cond} q / 50.0 >= 0.4 AND {where} GROUP BY ord, {label})"""


def graph(x: str = "", label: str = "cid", min_level: int = 0, where: str = "true") -> str:
    """Incidence, labels, pairs and the number of works, with a suffix."""
    return f"""{inc("inc" + x, label, min_level, where)},
lab{x} AS MATERIALIZED (SELECT label_id, arg_min(level, ord * 1000 + pos) AS level, count(*) AS works, min(ord * 1000 + pos) AS first FROM inc{x} GROUP BY label_id),
co{x} AS MATERIALIZED (SELECT s.label_id AS a, t.label_id AS b, count(*) AS observed FROM inc{x} s JOIN inc{x} t ON s.ord = t.ord AND s.label_id < t.label_id GROUP BY ALL),
n{x} AS (SELECT count(*) AS n FROM works WHERE {where})"""


def gaps(x: str = "", min_works: int = 15) -> str:
    return f"""gap{x} AS MATERIALIZED (
  SELECT s.label_id AS label_id_a, t.label_id AS label_id_b, s.works AS works_a, t.works AS works_b, coalesce(c.observed, 0) AS observed,
         s.works::DOUBLE * t.works / n.n::DOUBLE AS expected, n.n AS n, coalesce(c.observed, 0)::DOUBLE / (s.works::DOUBLE * t.works::DOUBLE) AS key
  FROM lab{x} s JOIN lab{x} t ON s.label_id < t.label_id AND s.works * t.works >= 3 * (SELECT n FROM n{x}) CROSS JOIN n{x} n
  LEFT JOIN co{x} c ON c.a = s.label_id AND c.b = t.label_id
  WHERE s.works >= {min_works} AND t.works >= {min_works})"""


_ORDER = "key, works_a * works_b DESC, label_id_a, label_id_b"
_GAP_ROWS = f"row_number() OVER (ORDER BY {_ORDER}) AS rank, label_id_a AS concept_a, label_id_b AS concept_b, works_a, works_b, observed, expected, observed / expected AS lift"
_SYM = "sym AS MATERIALIZED (SELECT a AS node, b AS other, observed FROM co UNION ALL SELECT b, a, observed FROM co)"


def top_gaps(label: str = "cid", min_level: int = 0, min_works: int = 15) -> str:
    return f"WITH {BASE}, {graph('', label, min_level)}, {gaps('', min_works)} SELECT {_GAP_ROWS} FROM gap ORDER BY {_ORDER} LIMIT {TOP}"


def top_labels(label: str) -> str:
    return f"""WITH {BASE}, {graph('', label)}, {_SYM},
nb AS (SELECT node, sum(observed) AS strength, arg_min(other, (-observed, other)) AS top_neighbor FROM sym GROUP BY node)
SELECT row_number() OVER (ORDER BY coalesce(strength, 0) DESC, works DESC, label_id, first) AS rank, label_id AS concept, level, works, coalesce(strength, 0)::BIGINT AS strength, top_neighbor
FROM lab LEFT JOIN nb ON node = label_id ORDER BY 1 LIMIT {TOP}"""


REFS = """hist AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
edges AS MATERIALIZED (SELECT 'W' || s.o_orderkey AS src, 'W' || t.o_orderkey AS dst FROM hist s JOIN hist t ON s.o_custkey = t.o_custkey AND t.i BETWEEN s.i - 5 AND s.i - 1),
nodes AS MATERIALIZED (SELECT 'W' || o_orderkey AS id FROM orders)"""


def pagerank(rounds: int) -> str:
    """Power iteration unrolled; afterwards ranks no longer move in the digits that are compared."""
    out = """size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
deg AS MATERIALIZED (SELECT src, count(*) AS d FROM edges GROUP BY src),
w AS MATERIALIZED (SELECT edges.src, dst, 1.0 / d AS w FROM edges JOIN deg ON deg.src = edges.src),
r0 AS MATERIALIZED (SELECT id, 1.0 / n AS r FROM nodes, size)"""
    for i in range(rounds):
        out += f""",
l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM deg)),
g{i} AS MATERIALIZED (SELECT dst, sum(r * w) AS g FROM r{i} JOIN w ON src = id GROUP BY dst),
r{i + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (coalesce(g, 0) + lost / n) AS r FROM nodes LEFT JOIN g{i} ON dst = id, size, l{i})"""
    return out


def split_graphs() -> str:
    return f"""{BASE}, {graph('', 'cid', 0, f'year <= {SPLIT}')}, {graph('2', 'cid', 0, f'year > {SPLIT}')}, {gaps()},
pairs AS MATERIALIZED (
  SELECT gap.*, gap.observed / expected AS lift, coalesce(s.works, 0) AS test_works_a, coalesce(t.works, 0) AS test_works_b, coalesce(c.observed, 0) AS test_observed,
         coalesce(s.works, 0)::DOUBLE * coalesce(t.works, 0) / n2.n::DOUBLE AS test_expected,
         CASE WHEN s.works * t.works > 0 THEN coalesce(c.observed, 0) / (s.works::DOUBLE * t.works / n2.n::DOUBLE) END AS test_lift,
         CASE WHEN gap.observed = 0 THEN 'train_lift = 0' WHEN 2 * gap.observed * gap.n < works_a * works_b THEN 'train_lift (0, 0.5)' WHEN gap.observed * gap.n < works_a * works_b THEN 'train_lift [0.5, 1)'
              WHEN gap.observed * gap.n < 2 * works_a * works_b THEN 'train_lift [1, 2)' ELSE 'train_lift >= 2' END AS bucket
  FROM gap CROSS JOIN n2 LEFT JOIN lab2 s ON s.label_id = label_id_a LEFT JOIN lab2 t ON t.label_id = label_id_b LEFT JOIN co2 c ON c.a = label_id_a AND c.b = label_id_b)"""


_SCORES = f"""{_SYM}, dg AS MATERIALIZED (SELECT node, count(*) AS d FROM sym GROUP BY node),
ev AS MATERIALIZED (SELECT *, test_observed > 0 AS label, row_number() OVER (ORDER BY test_expected, {_ORDER}) - 1 AS place, count(*) OVER () AS m FROM pairs WHERE test_expected >= 3),
cn AS MATERIALIZED (SELECT label_id_a, label_id_b, count(*) AS common, list_reduce(list_prepend(0.0::DOUBLE, list_sort(list(1.0 / ln(d)))), lambda x, y: x + y) AS adamic_adar
  FROM ev JOIN sym s ON s.node = label_id_a JOIN sym t ON t.node = label_id_b AND t.other = s.other JOIN dg ON dg.node = s.other GROUP BY ALL),
wide AS MATERIALIZED (SELECT ev.*, coalesce(common, 0) AS common, coalesce(adamic_adar, 0.0) AS adamic_adar,
  coalesce(p.d, 0) + coalesce(q.d, 0) - 2 * (observed > 0)::INTEGER - coalesce(common, 0) AS joint
  FROM ev LEFT JOIN cn USING (label_id_a, label_id_b) LEFT JOIN dg p ON p.node = label_id_a LEFT JOIN dg q ON q.node = label_id_b),
long AS MATERIALIZED (
  SELECT label_id_a, label_id_b, label, place, m, unnest(['lift', 'cooccurrence', 'preferential_attachment', 'common_neighbors', 'adamic_adar', 'jaccard']) AS scorer,
         unnest([lift, observed::DOUBLE, works_a::DOUBLE * works_b, common::DOUBLE, adamic_adar, CASE WHEN joint > 0 THEN common::DOUBLE / joint ELSE 0 END]) AS score FROM wide)"""


def scored(tail: str) -> str:
    return f"WITH {split_graphs()}, {_SCORES}{tail}"


def auroc(source: str, keys: str) -> str:
    return f"""SELECT {keys}, (sum(CASE WHEN label THEN mid END) - p * (p + 1) / 2) / nullif(p * q, 0) AS auroc, any_value(p + q) AS rows FROM (
  SELECT {keys}, label, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS mid,
         (count(*) FILTER (label) OVER (PARTITION BY {keys}))::DOUBLE AS p, (count(*) FILTER (NOT label) OVER (PARTITION BY {keys}))::DOUBLE AS q FROM {source}) GROUP BY {keys}, p, q"""


def precision(sign: str, positive: str) -> str:
    return scored(f""", ties AS (SELECT scorer, {sign}score AS s, count(*) AS n, count(*) FILTER ({positive}) AS p FROM long GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scorer ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ties),
cut AS (SELECT scorer, p, n, least(n, greatest({TOP} - before, 0)) AS slots FROM cum)
SELECT scorer, round(sum(p * slots / n) / nullif(sum(slots), 0), 6) AS precision FROM cut GROUP BY scorer""")


# Documents as works: words that stand four times or more are labels.
DOCS = """dw AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]{4,}')) AS w FROM documents),
inc AS MATERIALIZED (SELECT doc_id AS ord, w AS label_id FROM dw GROUP BY ALL HAVING count(*) >= 4),
lab AS MATERIALIZED (SELECT label_id, count(*) AS works, 2 AS level FROM inc GROUP BY label_id),
co AS MATERIALIZED (SELECT s.label_id AS a, t.label_id AS b, count(*) AS observed FROM inc s JOIN inc t ON s.ord = t.ord AND s.label_id < t.label_id
  WHERE s.label_id IN (SELECT label_id FROM lab WHERE works >= 5) AND t.label_id IN (SELECT label_id FROM lab WHERE works >= 5) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
txt AS MATERIALIZED (SELECT ord, s, list_distinct(string_split(trim(s), ' ')) AS ws FROM (
  SELECT doc_id AS ord, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) || ' ' AS s
  FROM documents WHERE instr(text, chr(10)) > 0 AND substr(text, instr(text, chr(10)) + 1) <> ''))"""


def verified(top: int | None, aliases: tuple[tuple[str, str], ...] = ()) -> str:
    """The first ``top`` pairs, or all of them, checked against the texts; aliases are (label, phrase)."""
    more = "".join(f" UNION SELECT ord, '{label}' FROM txt WHERE contains(s, ' {phrase} ')" for label, phrase in aliases)
    return f"""{DOCS}, {gaps('', 5)},
best AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, * FROM gap ORDER BY {_ORDER} {f"LIMIT {top}" if top else ""}),
hit AS MATERIALIZED (SELECT DISTINCT ord, w AS label_id FROM (SELECT ord, unnest(ws) AS w FROM txt{more}) WHERE w IN (SELECT label_id_a FROM best UNION SELECT label_id_b FROM best)),
ht AS (SELECT label_id, count(*) AS t FROM hit GROUP BY label_id),
bo AS (SELECT rank, count(*) AS o FROM best JOIN hit s ON s.label_id = label_id_a JOIN hit t ON t.label_id = label_id_b AND t.ord = s.ord GROUP BY rank),
ver AS MATERIALIZED (SELECT rank, label_id_a AS concept_a, label_id_b AS concept_b, expected, observed AS tag_observed, coalesce(p.t, 0) AS text_a, coalesce(q.t, 0) AS text_b,
  coalesce(p.t, 0)::DOUBLE * coalesce(q.t, 0) / greatest((SELECT count(*) FROM txt), 1)::DOUBLE AS text_expected, coalesce(o, 0) AS text_observed
  FROM best LEFT JOIN ht p ON p.label_id = label_id_a LEFT JOIN ht q ON q.label_id = label_id_b LEFT JOIN bo USING (rank)),
vt AS MATERIALIZED (SELECT *, CASE WHEN text_expected > 0 THEN text_observed / text_expected ELSE 0 END AS text_lift,
  CASE WHEN text_expected < 3 THEN 'unverifiable' WHEN text_observed = 0 THEN 'absent_in_text' ELSE 'co_mentioned' END AS verdict FROM ver)"""


# Orders as works that share an id by customer and year: (id, the work's reference inside or outside the corpus).
YEARLY = """y AS MATERIALIZED (SELECT 'C-' || o_custkey || '-' || year(o_orderdate) AS id, 'C-' || o_custkey || '-' || (year(o_orderdate) - 1) AS prev, 'X' || o_orderkey AS other, year(o_orderdate) AS year, o_orderkey AS k FROM orders),
edges AS MATERIALIZED (SELECT DISTINCT id AS src, prev AS dst FROM y WHERE prev IN (SELECT id FROM y))"""

# The pseudo-random score of pairs (a, b): a hash by bytes, modulo 2^64 in numbers of 128 bits.
_HASH = f"""list_reduce(list_prepend({0x6E65747363690001}::HUGEINT, list_transform(string_split(a || '|' || b, ''), lambda c: unicode(c)::HUGEINT)), lambda x, y: (xor(x, y) * {0x100000001B3}::HUGEINT) % {1 << 64}::HUGEINT)"""
_RANDOM = f"({_HASH} // 2048)::DOUBLE / {1 << 53}::DOUBLE"


def evaluation(label: str) -> str:
    """All scorers' figures without a null; ``label`` tells what counts as positive."""
    rank = lambda sign, positive, name: f"""{name}t AS (SELECT scorer, {sign}score AS s, count(*) AS n, count(*) FILTER ({positive}) AS p FROM every GROUP BY ALL),
{name}c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scorer ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}t),
{name} AS (SELECT scorer, round(sum(p * slots / n) / nullif(sum(slots), 0), 6) AS v FROM (SELECT scorer, p, n, least(n, greatest({TOP} - before, 0)) AS slots FROM {name}c) GROUP BY scorer)"""  # noqa: E731
    return scored(f""",
every AS MATERIALIZED (SELECT label_id_a, label_id_b, place, m, scorer, score, {label} AS label FROM (
  SELECT label_id_a, label_id_b, place, m, scorer, score FROM long UNION ALL
  SELECT a, b, place, m, 'random', {_RANDOM} FROM (SELECT label_id_a AS a, label_id_b AS b, place, m FROM ev)) JOIN (SELECT label_id_a, label_id_b, test_observed, test_lift FROM ev) USING (label_id_a, label_id_b)),
au AS MATERIALIZED ({auroc("every", "scorer")}),
st AS (SELECT scorer, sum(auroc * rows) / sum(CASE WHEN auroc IS NOT NULL THEN rows END) AS v FROM ({auroc("(SELECT *, floor(((place + 1) * 10 - 1) / m) AS stratum FROM every)", "scorer, stratum")}) GROUP BY scorer),
{rank("", "label", "hi")}, {rank("-", "NOT label", "lo")},
all_n AS (SELECT count(*) AS pairs, count(*) FILTER (label) AS positives FROM every WHERE scorer = 'lift')
SELECT scorer, pairs, positives, round(positives / nullif(pairs, 0), 6) AS base_rate, round(auroc, 6) AS auroc, round(st.v, 6) AS auroc_stratified,
  CASE WHEN scorer <> 'lift' THEN round((SELECT auroc FROM au WHERE scorer = 'lift') - auroc, 6) END AS delta, hi.v AS precision_at_k, lo.v AS gap_precision_at_k, 0::BIGINT AS permutations, least({TOP}, pairs)::BIGINT AS k
FROM (SELECT unnest(['lift', 'cooccurrence', 'preferential_attachment', 'common_neighbors', 'adamic_adar', 'jaccard', 'random']) AS scorer)
  LEFT JOIN au USING (scorer) LEFT JOIN st USING (scorer) LEFT JOIN hi USING (scorer) LEFT JOIN lo USING (scorer) CROSS JOIN all_n""")


def oracle_sql() -> dict[str, str]:
    one = f"WITH {BASE}, {graph()}"
    every = f"{one}, {gaps()}"
    replay = f"WITH {split_graphs()}"
    score = lambda name: scored(f" SELECT label_id_a, label_id_b, round(score, 9) AS score FROM long WHERE scorer = '{name}'")
    strata = auroc("(SELECT *, floor(((place + 1) * 10 - 1) / m) AS stratum FROM long)", "scorer, stratum")
    bridge = f"""best AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, * FROM gap ORDER BY {_ORDER} LIMIT {TOP}), {_SYM},
ed AS MATERIALIZED (SELECT node, other AS bridge, observed, observed::DOUBLE / (p.works::DOUBLE * q.works::DOUBLE) AS ratio, q.first FROM sym JOIN lab p ON p.label_id = node JOIN lab q ON q.label_id = other, n
  WHERE observed >= 3 AND q.works >= 15 AND observed * n.n > p.works * q.works),
br AS MATERIALIZED (SELECT rank, s.bridge, s.observed AS observed_a, t.observed AS observed_c,
  row_number() OVER (PARTITION BY rank ORDER BY least(s.ratio, t.ratio) DESC, least(s.observed, t.observed) DESC, s.bridge, s.first) AS place
  FROM best JOIN ed s ON s.node = label_id_a JOIN ed t ON t.node = label_id_b AND t.bridge = s.bridge WHERE s.bridge NOT IN (label_id_a, label_id_b) QUALIFY place <= 3)"""
    halves = f"{BASE}, {graph('', 'cid', 0, 'ord % 2 = 0')}, {gaps()}, {graph('3', 'cid', 0, 'ord % 2 = 1')}, {gaps('3')}"
    cohort = f"""best AS (SELECT label_id_a, label_id_b FROM pairs WHERE observed = 0 ORDER BY {_ORDER} LIMIT {TOP}),
cohorts(position, cohort) AS (VALUES (1, 'top_{TOP}_gaps'), (2, 'train_lift = 0'), (3, 'train_lift (0, 0.5)'), (4, 'train_lift [0.5, 1)'), (5, 'train_lift [1, 2)'), (6, 'train_lift >= 2'), (7, 'all_candidates')),
member AS (SELECT 'top_{TOP}_gaps' AS cohort, pairs.* FROM pairs JOIN best USING (label_id_a, label_id_b) UNION ALL SELECT bucket, pairs.* FROM pairs UNION ALL SELECT 'all_candidates', pairs.* FROM pairs),
sums AS (SELECT cohort, count(*) AS pairs, count(*) FILTER (test_observed > 0) AS hits, count(*) FILTER (test_expected >= 3) AS evaluable, count(*) FILTER (test_expected >= 3 AND test_observed > 0) AS evaluable_hits,
  median(test_expected) AS me, median(test_lift) AS ml FROM member GROUP BY cohort)"""
    scan = f"""WITH {BASE}, hist AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), c AS (SELECT ord, count(*) AS k FROM base GROUP BY ord)
SELECT o_orderkey AS ord, 'W' || o_orderkey AS id, 'Order ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS year, floor(o_totalprice)::BIGINT AS cited_by_count, least(i - 1, 5)::BIGINT AS n_refs, coalesce(k, 0)::BIGINT AS n_concepts, coalesce(k, 0)::BIGINT AS n_topics
FROM orders JOIN hist USING (o_orderkey) LEFT JOIN c ON c.ord = o_orderkey"""
    return {
        "scan_works": scan,
        "jsonl_round_trip": f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, * EXCLUDE (ord) FROM ({scan})",
        "api_pages": """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, * FROM orders WHERE o_orderkey % 10 <> 0)
SELECT ord, 'W' || o_orderkey AS id, 'Order ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS year, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice)::BIGINT ELSE 0 END AS cited_by_count, 'W' || (o_orderkey - 1) AS ref, 0::BIGINT AS n_concepts, 'order no' || o_orderkey || ' order' AS abstract
FROM o""",
        "normalize_ids": f"SELECT o_orderkey, CASE WHEN starts_with(raw, '{_ID}') THEN substr(raw, {len(_ID) + 1}) ELSE raw END AS id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{_ID}W' || o_orderkey ELSE 'W' || o_orderkey END AS raw FROM orders)",
        "dedup_works": "SELECT min(o_orderkey)::BIGINT AS ord, 'C-' || o_custkey || '-' || year(o_orderdate) AS id FROM orders GROUP BY 2",
        "abstracts": "SELECT doc_id, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0",
        "label_incidence": f"WITH {BASE}, {inc()} SELECT ord, label_id, level, pos FROM inc",
        "label_incidence_topics": f"WITH {BASE}, {inc('inc', 'tid')} SELECT ord, label_id, pos FROM inc",
        "label_filter_level": f"WITH {BASE}, {inc('inc', 'cid', 2)} SELECT label_id, count(*) AS works FROM inc GROUP BY label_id",
        "label_frequency": f"{one} SELECT label_id, label_id AS name, level, works, first // 1000 AS first_ord FROM lab",
        "cooccurrence_pairs": f"{one} SELECT a, b, observed FROM co",
        "label_strength": f"{one}, {_SYM} SELECT label_id, coalesce(sum(observed), 0)::BIGINT AS strength, count(observed) AS degree FROM lab LEFT JOIN sym ON node = label_id GROUP BY label_id",
        "top_neighbor": f"{one}, {_SYM} SELECT label_id, arg_min(other, (-observed, other)) FILTER (other IS NOT NULL) AS top_neighbor FROM lab LEFT JOIN sym ON node = label_id GROUP BY label_id",
        "concepts_top": top_labels("cid"),
        "topics_top": top_labels("tid"),
        "stats": f"""WITH {BASE}, {REFS}, {inc('t', 'tid')}, {inc('c', 'cid', 2)}, e AS (SELECT count(*) AS e FROM edges)
SELECT (SELECT count(*) FROM orders) AS works, min(year)::INTEGER AS year_min, max(year)::INTEGER AS year_max, any_value(e) AS internal_edges, any_value(e) AS total_references, CASE WHEN any_value(e) > 0 THEN 1.0::DOUBLE ELSE 0 END AS internal_ratio,
  (SELECT count(DISTINCT label_id) FROM t) AS topics, (SELECT count(DISTINCT label_id) FROM c) AS concepts, 0::BIGINT AS abstracts FROM works, e""",
        "citation_edges": f"WITH {REFS} SELECT src, dst FROM edges",
        "in_degree": f"WITH {REFS} SELECT id, count(src) AS in_corpus_citations FROM nodes LEFT JOIN edges ON dst = id GROUP BY id",
        "citation_edges_yearly": f"WITH {YEARLY} SELECT src, dst FROM edges",
        "in_degree_yearly": f"WITH {YEARLY} SELECT id, count(src) AS in_corpus_citations FROM (SELECT DISTINCT id FROM y) LEFT JOIN edges ON dst = id GROUP BY id",
        "stats_yearly": f"""WITH {YEARLY}, r AS (SELECT id, prev FROM y UNION SELECT id, other FROM y), e AS (SELECT count(*) AS e FROM edges), t AS (SELECT count(*) AS t FROM r)
SELECT count(DISTINCT id) AS works, min(year)::INTEGER AS year_min, max(year)::INTEGER AS year_max, any_value(e) AS internal_edges, any_value(t) AS total_references, round(any_value(e) / any_value(t), 9) AS internal_ratio, 0::BIGINT AS topics, 0::BIGINT AS concepts, count(*) FILTER (k % 3 = 0) AS abstracts FROM y, e, t""",
        "pagerank_orders": f"WITH {REFS}, {pagerank(60)} SELECT id, round(r, 9) AS pagerank FROM r60",
        "pagerank_parts": f"""WITH ln AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), edges AS MATERIALIZED (SELECT DISTINCT s.l_partkey AS src, t.l_partkey AS dst FROM ln s JOIN ln t ON s.l_orderkey = t.l_orderkey AND t.l_linenumber = s.l_linenumber + 1 WHERE s.l_partkey <> t.l_partkey),
nodes AS MATERIALIZED (SELECT p_partkey AS id FROM part), {pagerank(40)} SELECT id, round(r, 8) AS pagerank FROM r40""",
        "citations_top": f"""WITH {REFS}, {pagerank(60)}, deg_in AS (SELECT id, count(src) AS c FROM nodes LEFT JOIN edges ON dst = id GROUP BY id), x AS (SELECT row_number() OVER (ORDER BY round(r, 12) DESC, c DESC, id) AS rank, id, r, c FROM r60 JOIN deg_in USING (id))
SELECT rank, id, 'Order ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS year, round(r, 9) AS pagerank, c AS in_corpus_citations, floor(o_totalprice)::BIGINT AS cited_by_count FROM x JOIN orders ON id = 'W' || o_orderkey WHERE rank <= {TOP}""",
        "gaps_top": top_gaps(),
        "gaps_topics_top": top_gaps("tid"),
        "gaps_min_level": top_gaps("cid", 2, 5),
        "gaps_all": f"{every} SELECT label_id_a, label_id_b, works_a, works_b, observed, expected, observed / expected AS lift FROM gap",
        "bridges": f"{every}, {bridge} SELECT rank, bridge, observed_a, observed_c, place FROM br",
        "gaps_bridged": f"""{every}, {bridge}, cell AS (SELECT rank, string_agg(bridge || ' (' || observed_a || '|' || observed_c || ')', '; ' ORDER BY place) AS bridges FROM br GROUP BY rank)
SELECT rank, label_id_a AS concept_a, label_id_b AS concept_b, works_a, works_b, observed, expected, observed / expected AS lift, coalesce(bridges, '') AS bridges FROM best LEFT JOIN cell USING (rank)""",
        "text_normalize": """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b FROM documents), u AS (SELECT doc_id, CASE WHEN b = '' THEN ' ' ELSE ' ' || lower(b) || ' ' END AS s FROM t)
SELECT doc_id, sha256(s) AS digest, length(s) AS n FROM u""",
        "label_terms": "SELECT p_partkey, ' ' || lower(trim(regexp_replace(p_name, '[^\\p{L}\\p{N}]+', ' ', 'g'))) || ' ' AS term FROM part",
        "title_cut": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS title FROM documents",
        "text_hits_words": f"WITH {DOCS} SELECT w AS label_id, count(*) AS works FROM (SELECT ord, unnest(ws) AS w FROM txt) WHERE w IN (SELECT label_id FROM lab WHERE works >= 5) GROUP BY w",
        "text_hits_phrases": f"""WITH {DOCS}, p(label_id, phrase) AS (VALUES ('en', 'of the'), ('en', 'to the'), ('de', 'und der'), ('fr', 'de la'), ('one', 'that'), ('one', 'is to'), ('one', 'and a'))
SELECT label_id, count(DISTINCT ord) AS works FROM txt JOIN p ON contains(s, ' ' || phrase || ' ') GROUP BY label_id""",
        "verify_aliases": f"WITH {verified(TOP, (('that', 'of the'), ('with', 'in the'), ('pour', 'de la')))} SELECT * FROM vt",
        # What stands ``RADIUS`` bytes before a word and twice as many from it on, widened to whole characters.
        "snippets": f"""WITH {DOCS}, f AS (SELECT ord, s, least(coalesce(nullif(instr(s, ' that '), 0), 1e9), coalesce(nullif(instr(s, ' with '), 0), 1e9))::BIGINT AS p FROM txt),
c AS (SELECT ord, p, right(substr(s, 1, p - 1), {RADIUS}) AS l, substr(s, p, {2 * RADIUS}) AS r FROM f)
SELECT ord, CASE WHEN p = 1e9 THEN '' ELSE '…' || trim(right(l, coalesce(list_filter(range(0, {RADIUS + 1}), lambda n: strlen(right(l, n)) >= {RADIUS})[1], {RADIUS})) ||
  left(r, coalesce(list_filter(range(0, {2 * RADIUS + 1}), lambda n: strlen(left(r, n)) >= {2 * RADIUS})[1], {2 * RADIUS}))) || '…' END AS snippet FROM c""",
        "verify_top": f"WITH {verified(TOP)} SELECT * FROM vt",
        "evidence_sample": f"""WITH {DOCS}, h AS MATERIALIZED (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS p, count(*) OVER () AS total FROM txt WHERE list_contains(ws, 'that') AND list_contains(ws, 'with')),
k AS (SELECT *, (p * 10 + total - 1) // total AS k FROM h)
SELECT row_number() OVER (ORDER BY p) AS rank, 'D' || ord AS id, (2018 + ord % 7)::INTEGER AS year, ord IN (SELECT ord FROM inc WHERE label_id = 'that') AS tag_a, ord IN (SELECT ord FROM inc WHERE label_id = 'with') AS tag_b, total, '{_ID}D' || ord AS url
FROM k WHERE total <= 10 OR (k < 10 AND (k * total) // 10 = p)""",
        "backtest_pairs": f"{replay} SELECT label_id_a, label_id_b, works_a, works_b, observed, expected, test_works_a, test_works_b, test_observed, test_expected, test_lift FROM pairs",
        "backtest_top": f"""{replay} SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, label_id_a AS concept_a, label_id_b AS concept_b, works_a AS train_works_a, works_b AS train_works_b, expected AS train_expected, test_works_a, test_works_b, test_observed, test_expected, test_lift
FROM pairs WHERE observed = 0 ORDER BY 1 LIMIT {TOP}""",
        "backtest_summary": f"""{replay}, {cohort} SELECT position::BIGINT AS position, cohort, coalesce(pairs, 0) AS pairs, coalesce(hits, 0) AS hits, hits / nullif(pairs, 0)::DOUBLE AS hit_rate, coalesce(evaluable, 0) AS evaluable, coalesce(evaluable_hits, 0) AS evaluable_hits,
  evaluable_hits / nullif(evaluable, 0)::DOUBLE AS evaluable_hit_rate, round(me, 6) AS median_test_expected, round(ml, 6) AS median_test_lift FROM cohorts LEFT JOIN sums USING (cohort)""",
        "lift_bucket": f"{replay} SELECT bucket, count(*) AS pairs FROM pairs GROUP BY bucket",
        "evaluable_pairs": f"{replay} SELECT label_id_a, label_id_b, coalesce(test_lift >= 1, false) AS label FROM pairs WHERE test_expected >= 3",
        "scorer_lift": score("lift"),
        "scorer_cooccurrence": score("cooccurrence"),
        "scorer_pref_attach": score("preferential_attachment"),
        "scorer_common_neighbors": score("common_neighbors"),
        "scorer_adamic_adar": score("adamic_adar"),
        "scorer_jaccard": score("jaccard"),
        "scorer_random": f"WITH {split_graphs()}, ev AS (SELECT label_id_a AS a, label_id_b AS b FROM pairs WHERE test_expected >= 3) SELECT a AS label_id_a, b AS label_id_b, round({_RANDOM}, 9) AS score FROM ev",
        "evaluate_scorers": evaluation("test_observed > 0"),
        "evaluate_scorers_above_chance": evaluation("coalesce(test_lift >= 1, false)"),
        "auroc_by_scorer": scored(f" SELECT scorer, round(auroc, 6) AS auroc FROM ({auroc('long', 'scorer')})"),
        "auroc_strata": scored(f" SELECT scorer, round(sum(auroc * rows) / sum(CASE WHEN auroc IS NOT NULL THEN rows END), 6) AS auroc_stratified FROM ({strata}) GROUP BY scorer"),
        "precision_at_k": precision("", "label"),
        "gap_precision_at_k": precision("-", "NOT label"),
        "split_year_rule": "WITH y AS (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS works FROM orders GROUP BY 1), s AS (SELECT year, works, sum(works) OVER (ORDER BY year) / sum(works) OVER () AS share FROM y) SELECT year, works, round(share, 6) AS share FROM s WHERE share >= 0.5 ORDER BY year LIMIT 1",
        "poisson_expected_zeros": f"{every} SELECT count(*) AS pairs, count(*) FILTER (observed = 0) AS zeros, round(coalesce(sum(exp(-expected)), 0), 4) AS expected_zeros FROM gap",
        "spearman_tag_vs_text": f"""WITH {verified(None)}, r AS (SELECT rank() OVER (ORDER BY tag_observed / expected) + (count(*) OVER (PARTITION BY tag_observed / expected) - 1) / 2.0 AS x, rank() OVER (ORDER BY text_lift) + (count(*) OVER (PARTITION BY text_lift) - 1) / 2.0 AS y FROM vt)
SELECT count(*) AS pairs, round(corr(x, y), 6) AS rho FROM r""",
        "verify_by_bucket": f"""WITH {verified(None)} SELECT CASE WHEN tag_observed = 0 THEN '0' WHEN tag_observed / expected < 0.5 THEN '(0, 0.5)' WHEN tag_observed / expected < 1 THEN '[0.5, 1)' WHEN tag_observed / expected < 2 THEN '[1, 2)' ELSE '>= 2' END AS bucket, verdict, count(*) AS pairs FROM vt GROUP BY ALL""",
        "corpus_diff": f"""WITH {halves}, x AS (SELECT label_id_a AS name_a, label_id_b AS name_b, observed / expected AS lift_1 FROM gap WHERE observed / expected < 1), y AS (SELECT label_id_a AS name_a, label_id_b AS name_b, observed / expected AS lift_2 FROM gap3 WHERE observed / expected < 1)
SELECT name_a, name_b, lift_1, lift_2, lift_1 IS NOT NULL AND lift_2 IS NOT NULL AS in_both FROM x FULL JOIN y USING (name_a, name_b)""",
    }
