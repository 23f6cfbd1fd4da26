"""The queries of this subpackage: each applies an operator with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontam, html_text, itq, orc_tokens, pii, quality, simhash, urls, warc
from lacuna.llm.common import fresh_path, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pre-token pattern of the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether the checksum of an id, as text, leaves no remainder by five; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The model fitted on labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return quality.train(table(spark, sf_dir, "documents") if docs is None else docs, labels)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "tokens")
    orc_tokens.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"))
    return orc_tokens.checksums(spark, path, docs.schema["doc_id"].dataType.simpleString())


def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    warc.write(warc.to_records(pages), path)
    return warc.digest(warc.read(spark, path), pages.schema["page_id"].dataType.simpleString())


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern()))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(pages, urls.outcomes_of(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lacuna.llm import pipeline

    own = (op1_pii, op2_quality, op3_orc_tokens, op4_itq, op5_simhash, op6_warc, op7_html, op8_decontam, op9_bpe, op10_urls)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
         label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))), false)
           AND coalesce(list_bool_or(list_transform(embedding, lambda e: e <> 0)), false) AS ok
  FROM embeddings),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, a.vec_id AS ia, b.vec_id AS ib FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
  WHERE a.ok AND b.ok AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b, ib) AS (
  SELECT r, r, vec_id FROM v
  UNION
  SELECT reach.a, l.b, l.ib FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(ib) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS s FROM p),
g AS (SELECT s, n, max(page_id) AS last FROM h GROUP BY s, n),
d AS (SELECT h.page_id, h.n, h.s, g.last FROM h JOIN g USING (s, n))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""

OP8_SQL = """
WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN sizes ON len(w) >= n)),
hit AS MATERIALIZED (SELECT r, dg.n, i, item_id FROM dg JOIN win ON win.g = dg.g AND win.n = dg.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""


def _op10_sql() -> str:
    """Rules and reputations; each level's prior has the mean of the level above."""
    last2 = "array_to_string(string_split(host, '.')[-2:], '.')"
    last3 = "array_to_string(string_split(host, '.')[-3:], '.')"
    last1 = "string_split(host, '.')[-1]"
    address, two = f"regexp_matches(host, '{urls._ADDRESS}')", f"regexp_full_match({last2}, '({'|'.join(urls.SECOND_LEVEL)})\\.[a-z][a-z]')"
    domain = f"CASE WHEN {address} THEN host WHEN {two} THEN {last3} ELSE {last2} END"
    suffix = f"CASE WHEN {address} THEN host WHEN {two} THEN {last2} ELSE {last1} END"
    levels = ""
    for key, up in (("all_", None), ("suffix", "all_"), ("domain", "suffix"), ("host", "domain")):
        mean = f"coalesce((SELECT mean FROM p_{up} q WHERE q.key = o.{up}), 0.5)" if up else "0.5"
        keys = f"{key}, {up}" if up else key
        levels += f"""
c_{key} AS (SELECT {key} AS key, sum(good) AS good, sum(n) AS n, any_value({mean}) AS m FROM o GROUP BY {keys}),
r_{key} AS (SELECT (sum(n * (good / n - m) ** 2) / nullif(sum(m * (1 - m)), 0) - 1) / nullif(sum(n) / nullif(count(*), 0) - 1, 0) AS rho FROM c_{key}),
s_{key} AS (SELECT coalesce(greatest({urls.WEAKEST}, least({urls.STRONGEST}, CASE WHEN rho <= 0 THEN {urls.STRONGEST} ELSE 1 / rho - 1 END)), {urls.STRONGEST}) AS s FROM r_{key}),
p_{key} AS (SELECT key, s * m + good AS a, s * (1 - m) + n - good AS b, (s * m + good) / (s + n) AS mean FROM c_{key}, s_{key}),"""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(u.host = '{h}' OR ends_with(u.host, '.{h}')) AND starts_with(u.path, '{p}')", h + p, said) for said, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    return f"""
WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, {domain} AS domain, {suffix} AS suffix, '*' AS all_, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n
      FROM u JOIN g ON g.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html?)?/?$', 1), '') AS BIGINT) WHERE host <> '' GROUP BY host),{levels}
k AS (SELECT host, {domain} AS domain, {suffix} AS suffix FROM (SELECT DISTINCT host FROM u)),
ab AS (SELECT k.host, coalesce(h.a, d.a, s.a, t.a, 1.0) AS a, coalesce(h.b, d.b, s.b, t.b, 1.0) AS b FROM k
       LEFT JOIN p_host h ON h.key = k.host LEFT JOIN p_domain d ON d.key = k.domain LEFT JOIN p_suffix s ON s.key = k.suffix LEFT JOIN p_all_ t ON t.key = '*'),
v AS (SELECT host, CASE WHEN least(1.0, a / (a + b) + {urls.DEVIATIONS} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) < {urls.LEAST_GOOD} THEN 'block' ELSE 'allow' END AS own FROM ab)
SELECT u.page_id, u.host, u.path, {rule} AS rule, coalesce({said}, v.own) AS verdict FROM u JOIN v ON v.host = u.host
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express."""
    return {"op4_itq": OP4_SQL, "op6_warc": OP6_SQL, "op8_decontam": OP8_SQL, "op10_urls": _op10_sql()}
