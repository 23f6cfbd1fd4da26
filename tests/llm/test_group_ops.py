"""Operators that compare rows with each other, the archive and the URL filter, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
import xxhash

from lacuna.llm import itq, simhash, urls, warc
from lacuna.llm import queries as Q
from lacuna.llm.components import components, forest

from .test_text_ops import EDGES, clashing, docs


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("plain", [0, 100_000])
def test_components(spark, plain, monkeypatch):
    from lacuna.llm import components as C

    monkeypatch.setattr(C, "PLAIN_EDGES", plain)
    rnd = random.Random(7)
    for n, m in ((40, 30), (20, 20), (30, 200)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        if m == 20:
            edges = [(i, i + 1) for i in range(n - 1)]  # a path
        want = roots(n, edges)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
        assert got == {i: want[i] for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_forest():
    rnd = random.Random(3)
    for _ in range(50):
        n = rnd.randint(1, 30)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 30))]
        label = np.arange(n)
        for i in range(0, len(edges), 7):
            forest(label, *np.array(edges[i : i + 7]).T)
        assert label.tolist() == roots(n, edges)


def plain_fingerprint(text):
    import re

    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choice(["A", "b", "É", " ", "\n", "\x0b", "\x1c", "\x85", "xyz "]) for _ in range(rnd.randint(0, 60)))
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
    long = " ".join(str(rnd.random()) for _ in range(70_000))
    assert simhash.fingerprint(long) != 0


def near_points(seed):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64).tolist()
    pts = set(base)
    for x in base[:100]:
        for _ in range(3):
            y = x
            for _ in range(rnd.randint(1, 5)):
                y ^= 1 << rnd.randrange(64)
            pts.add(y)
    pts.update(base[0] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i))
    return np.array(sorted(pts), dtype=np.uint64)


@pytest.mark.parametrize("node_rows", [7, 16_384])
def test_trie_join_equals_all_pairs(spark, node_rows):
    p = near_points(node_rows)
    u, v = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3, 1))
    want = roots(len(p), list(zip(u.tolist(), v.tolist(), strict=True)))
    df = spark.createDataFrame([(x,) for x in p.view(np.int64).tolist()], "fp bigint")
    at = {x: i for i, x in enumerate(p.view(np.int64).tolist())}
    edges = [(at[r["u"]], at[r["v"]]) for r in simhash._links(df, 3, node_rows).collect()]
    assert all(np.bitwise_count(p[a] ^ p[b]) <= 200 for a, b in edges)
    assert roots(len(p), edges) == want


def test_simhash_query(spark, sf):
    rows = {r["doc_id"]: r for r in Q.op5_simhash(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = np.array([plain_fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    u, v = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    want = roots(len(ids), list(zip(u.tolist(), v.tolist(), strict=True)))
    for i, doc in enumerate(ids):
        assert rows[doc]["fingerprint"] == f"{int(fps[i]):016x}"
        assert rows[doc]["component_id"] == ids[want[i]]


def test_simhash_edges(spark):
    d = clashing(docs(spark, EDGES))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    assert len(rows) == len(EDGES)
    assert rows[0]["fp"] == 0 and rows[2]["component_id"] == 0 and rows[4]["component_id"] == 3
    kept = sorted(r["doc_id"] for r in simhash.keep_one(d).collect())
    assert kept == sorted({r["component_id"] for r in rows.values()})
    assert simhash.keep_one(d).columns == d.columns
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    assert simhash.keep_one(d.limit(0)).count() == 0
    twice = docs(spark, ["same words here now", "same words here now", "other"]).union(docs(spark, ["same words here now"])).union(spark.createDataFrame([(None, "same words here now", None, None, None)], docs(spark, []).schema))
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [0, 2]
    assert {r["component_id"] for r in simhash.near_duplicates(twice).where("doc_id is null").collect()} == {0}


def test_keep_one_takes_a_row_of_each_group(spark):
    from pyspark.sql import functions as F

    one, other, third = "some words that are here", "quite another text stands there", "and this one is alone, too"
    rows = docs(spark, [one, other]).union(docs(spark, [third, one])).union(docs(spark, [None, None]).select(F.lit(None).cast("bigint"), "text", "lang", "source", "n_chars"))
    rows = rows.union(rows.where("text is null"))
    # Ids 0 and 1 each stand for two texts; rows without an id are a group like any other.
    for df in (rows, clashing(rows), rows.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] is None, r["text"] or "") for r in kept.collect()) == sorted([(False, one), (False, other), (False, third), (True, "")])
    # Rows that agree in id and text: one stays, the same at any partitioning.
    same = docs(spark, [one]).union(docs(spark, [one]).withColumn("lang", F.lit("de"))).withColumn("_first", F.lit(1))
    assert {simhash.keep_one(same.repartition(n)).first()["lang"] for n in (1, 2, 3)} == {"de"}


def test_hot_keys_are_not_dealt(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lacuna.llm import common

    rows = spark.createDataFrame([(i, 0 if i % 3 else None if i % 5 == 0 else i) for i in range(300)], "v int, k int")
    keyed = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    want = sorted(map(str, rows.join(keyed.drop("n"), "k", "left").select("v", "k", "most").collect()))
    for most in (1, 10, 1_000):
        monkeypatch.setattr(common, "HOT_KEYS", most)
        assert sorted(map(str, common.join_counted(rows, keyed, "k", "n", "left").select("v", "k", "most").collect())) == want
        assert common.join_counted(rows, keyed, "k", "n").count() == rows.where("k is not null").count()


VEC = "vec_id bigint, embedding array<float>, label int"


def plain_links(rows):
    ok = []
    for i, (_, x, label) in enumerate(rows):
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x):
            ok.append(i)
    edges = []
    for k, i in enumerate(ok):
        for j in ok[k + 1 :]:
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and len(a) == len(b):
                a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    edges.append((i, j))
    return edges


def vectors(seed, n=160, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = [base[rng.integers(12)] + rng.standard_normal(dim) * 0.1 for _ in range(n // 2)]
    rows = [(i, x.astype(np.float32).tolist(), int(rng.integers(2))) for i, x in enumerate([*base, *near])]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim, base[0][:3].tolist()]
    rows += [(1000 + i, x, 0) for i, x in enumerate(odd)] + [(2000, rows[0][1], None), (3000, rows[0][1], rows[0][2]), (3000, rows[0][1], rows[0][2]), (3001, [2 * x for x in rows[0][1]], rows[0][2])]
    return rows


@pytest.mark.parametrize("bucket_rows", [5, 2048])
def test_itq_equals_all_pairs(spark, bucket_rows):
    rows = vectors(bucket_rows)
    got = itq.near_duplicates(clashing(spark.createDataFrame(rows, VEC)), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    edges = plain_links(rows)
    want = roots(len(rows), edges)
    links = np.bincount(np.array(edges, dtype=int).ravel(), minlength=len(rows))
    least = {r: min(rows[i][0] for i in range(len(rows)) if want[i] == r) for r in set(want)}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((rows[i][0], int(links[i]), least[want[i]], rows[i][0] == least[want[i]]) for i in range(len(rows)))


def test_itq_in_few_dimensions(spark):
    for dim in (1, 2, 3):
        rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(np.random.default_rng(dim).standard_normal((120, dim)))]
        found = sum(r["n_links"] for r in itq.near_duplicates(spark.createDataFrame(rows, VEC)).collect()) / 2
        assert found >= 0.97 * len(plain_links(rows))


def test_itq_finds_links_where_all_vectors_point_one_way(spark):
    x = (np.random.default_rng(5).standard_normal((300, 64)) + 20).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = sum(r["n_links"] for r in itq.near_duplicates(spark.createDataFrame(rows, VEC)).collect()) / 2
    assert found >= 0.99 * len(plain_links(rows))


def test_itq_recall_at_the_threshold():
    """Pairs whose cosine is just that of the threshold, the hardest ones, among many rows: they meet, within the bound."""
    rng = np.random.default_rng(8)
    x = itq._unit(rng.standard_normal((100_000, 64)))
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * itq._unit(away)
    index = itq.Index(x[:10_000], 0.98)
    a, b = index.codes(x), index.codes(y)
    found = ((itq.keys_of(a) == itq.keys_of(b)).any(1)) & (np.bitwise_count(a ^ b).sum(1) <= index.bound)
    assert found.mean() > 0.99
    assert index.bound < itq.BITS * itq.ROTATIONS / 2


def test_itq_recall_and_edges(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = sum(r["n_links"] for r in Q.op4_itq(spark, sf).collect()) / 2
    assert found >= 0.99 * len(plain_links(rows))
    assert itq.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    same = [(i, [1.0, 2.0], 1) for i in range(5)] + [(9, [1.0, 2.02], 1), (10, [-1.0, 2.0], 1)]
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark.createDataFrame(same, VEC)).collect()}
    assert got == {**dict.fromkeys(range(5), 5), 9: 5, 10: 0}


PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    rows = [(1, "http://a/x y\r\n", "<p>é"), (2, None, "<p>é"), (3, "http://b", ""), (4, "http://c", None), (5, "u", "a\r\n\r\nb"), (6, "u", "WARC/1.1\r\n" * 2000), (7, "u", "é" * 200_000), (None, "u", "<p>é"), (2, None, "<p>é")]
    path = (tmp_path / compression).as_uri()
    warc.write(warc.to_records(clashing(spark.createDataFrame(rows, PAGES))).repartition(3), path, compression)
    got = warc.digest(warc.read(spark, path)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, h in rows:
        if i is not None:
            by.setdefault((h or "").encode(), []).append(i)
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        raw = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        last = max(by[raw])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
    types = warc.read(spark, path).where("record_type = 'revisit'")
    assert {r["record_type"] for r in types.collect()} == {"revisit"}
    assert warc.read(spark, path, "response").where("payload is null").count() == 0
    assert warc.read(spark, path, headers={"WARC-Target-URI": "http://b"}).count() == 1
    assert warc.read(spark, path, "response", payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, path, "response").where("target_uri = 'http://a/x%20y%0D%0A'").count() == 0  # a revisit
    again = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, path, "response").collect()}
    assert again[f"{warc.URN}6"] == b"WARC/1.1\r\n" * 2000


def test_warc_splits_and_foreign_files(spark, tmp_path):
    path = tmp_path / "many"
    rows = [(i, "u", f"page {i} " * 50) for i in range(300)]
    records = warc.to_records(spark.createDataFrame(rows, PAGES)).coalesce(1)
    spark.dataSource.register(warc.WarcDataSource)
    records.write.format("warc").option("split_bytes", "2000").mode("append").save(path.as_uri())
    assert warc.read(spark, path.as_uri()).rdd.getNumPartitions() > 10
    assert warc.read(spark, path.as_uri()).select("record_id").distinct().count() == 300
    import gzip

    other = tmp_path / "other"
    other.mkdir()
    one = [warc.record("response", f"urn:x:{i}", "u", warc.digest_of(b"x" * i), i, b"x" * i) for i in range(5)]
    (other / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    (other / "b.warc").write_bytes(b"".join(one))
    got = warc.read(spark, other.as_uri()).collect()
    assert sorted(len(r["payload"]) for r in got) == sorted([*range(5)] * 2)
    # All records in one member, and in members of two; then files that are cut off.
    one_member = gzip.compress(b"".join(one))
    for name, raw in (("one", one_member), ("two", gzip.compress(one[0] + one[1]) + gzip.compress(b"".join(one[2:])))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(raw)
        assert sorted(len(r["payload"]) for r in warc.read(spark, (tmp_path / name).as_uri()).collect()) == [*range(5)]
        assert warc.read(spark, (tmp_path / name).as_uri(), payload=False).count() == 5
    for name, raw in (("cut.warc", b"".join(one)[:-8]), ("head.warc", b"".join(one)[: -len(one[4]) + 30]), ("cut.warc.gz", one_member[:-30]), ("member.warc.gz", b"".join(map(warc.gzip_member, one))[:-9]), ("other.warc", b"".join(one) + b"no record\r\n\r\n")):
        folder = tmp_path / name.replace(".", "-")
        folder.mkdir()
        (folder / name).write_bytes(raw)
        with pytest.raises(Exception, match=f"{name}, record at byte"):
            warc.read(spark, folder.as_uri()).collect()
        assert warc.read(spark, folder.as_uri(), on_error="skip").count() == (5 if name == "other.warc" else 4)
    warc.write(warc.to_records(spark.createDataFrame([], PAGES)), (tmp_path / "none").as_uri())
    assert warc.read(spark, (tmp_path / "none").as_uri()).count() == 0


def test_warc_with_a_listing_too_long_to_broadcast(spark, monkeypatch):
    from lacuna.llm import common

    rows = spark.createDataFrame([(i, "u", "same" if i % 3 else f"page {i % 4}") for i in range(60)], PAGES)
    want = sorted(map(str, warc.to_records(rows).collect()))
    for listed, hot in ((0, 1_000), (0, 2)):
        monkeypatch.setattr(common, "LISTED_ROWS", listed)
        monkeypatch.setattr(common, "HOT_KEYS", hot)
        assert sorted(map(str, warc.to_records(rows).collect())) == want


def test_warc_below_least_bytes_all_are_responses(spark):
    rows = warc.to_records(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES), least_bytes=3).collect()
    assert sorted(r["record_type"] for r in rows) == ["response", "response", "response", "revisit"]


def test_url_rules_and_edges(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://m.example.com/en/x", "m.example.com", "/en/x", "example.com/en/", "block"),
        (3, "http://example.com/de/", "example.com", "/de/", "com/", "allow"),
        (4, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        (5, "http://a.net/es", "a.net", "/es", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/x", "", "", None, "allow"),
        (8, "http://notexample.com", "notexample.com", "", None, "allow"),
        (8, "http://x?y/en/", "x", "", None, "allow"),
        (None, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (9, "http://example.com/en", "example.com", "/en", "com/", "allow"),
        (10, "http://h/a\nb?c", "h", "/a\nb", None, "allow"),
    ]
    pages = clashing(spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id bigint, url string"))
    none = spark.createDataFrame([], "host string, good bigint, n bigint")
    got = urls.judge(pages, none).collect()
    assert sorted(map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got])) == sorted(map(str, [(r[0], *r[2:]) for r in rows]))
    assert urls.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    out = spark.createDataFrame([("bad.one.org", 0, 200), ("good.one.org", 190, 200), ("new.two.org", 0, 1), ("x.three.org", 95, 100), ("y.three.org", 97, 100)], "host string, good bigint, n bigint")
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["bad.one.org", "good.one.org", "new.two.org", "never.three.org", "q.zz"])], "page_id bigint, url string")
    rows = {r["host"]: r for r in urls.judge(pages, out).collect()}
    assert rows["bad.one.org"]["verdict"] == "block"
    assert rows["good.one.org"]["verdict"] == rows["new.two.org"]["verdict"] == rows["never.three.org"]["verdict"] == "allow"
    assert rows["new.two.org"]["mean"] > 0.1
    assert rows["never.three.org"]["mean"] > 0.8


def test_suffixes(spark):
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.example.com",), ("",)], "h string")
    got = [tuple(r) for r in hosts.select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("", "")]
