"""Operators that work on one text at a time, against plain versions, and what each does at the edges."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyarrow.orc import ORCFile
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontam, html_text, orc_tokens, pii, quality
from lacuna.llm import queries as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """With columns that an operator might use itself."""
    from pyspark.sql import functions as F

    for name in ("id", "score", "spans", "_id", "_text", "block", "ids", "part", "fp", "_hit", "component_id", "_kept", "n", "row", "_first", "key", "vec", "first", "host", "path", "upper", "mean", "headers", "payload"):
        df = df.withColumn(name, F.lit("x"))
    return df


LONG = "wörd Abc, 12 x@y.zz +1 (555) 123-4567 " * 30_000
EDGES = [None, "", " \n\t ", "a", "a", LONG, "é" * 50_000, "🙂 ab\u0301c", "a" * 300_000]


def plain_pii(text):
    """Base spans by the given patterns alone."""
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_pii_base_equals_patterns():
    rnd = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", "1", "42", ".", "255", "256", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+49 30 1234567", "1.2.3.4", "é", "%", "_", "10.0.0.1", "4012888888881881", "@@", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        got = [s[:3] for s in pii.find_spans(t) if s.kind in pii.BASE_KINDS]
        assert got == plain_pii(t), t


def test_pii_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("nr GB82 WEST 1234 5698 7654 33 ok") == []
    assert kinds("SSN 123-45-6789") == ["ssn"]
    assert kinds("code 123-45-6789") == []
    assert kinds("call 555-123-4567 now") == ["phone_local"]
    assert pii.masked("a x@y.zz b", pii.find_spans("a x@y.zz b")) == "a <email> b"


def test_pii_edges(spark):
    rows = pii.digest(pii.detect(clashing(docs(spark, EDGES)))).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(EDGES)))
    for r, t in zip(rows, EDGES, strict=True):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(t))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert rows[0]["spans"] == ""
    assert rows[5]["n_email"] == 30_000
    assert pii.digest(pii.detect(docs(spark, []))).count() == 0
    out = pii.redact(clashing(docs(spark, [*EDGES, "x@y.zz"]))).orderBy("doc_id").collect()
    assert out[0]["text"] is None and out[-1]["text"] == "<email>" and out[-1]["score"] == "x"


def test_pii_query_equals_patterns(spark, sf):
    from pyspark.sql import functions as F

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op1_pii(spark, sf).collect():
        want = plain_pii(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert F is not None


def test_quality_is_accurate_on_held_out_rows(spark, sf):
    rows = Q.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3)
    out = [r for r in rows if r["held_out"]]
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_sum_of_squares_equals_pairs():
    rng = np.random.default_rng(0)
    some = [quality.features("a b c d e f", None), quality.features("x y", 3)]
    m = quality.fit(some, np.array([1.0, 0.0], np.float32), epochs=2)
    m.v[:] = rng.standard_normal(m.v.shape)
    idx, val, start = m.entries(some)
    z, _ = m.margin(idx, val, start)
    for d, (a, b) in enumerate(zip(start, [*start[1:], len(idx)], strict=True)):
        want = m.w0 + sum(float(m.w[i]) * v for i, v in zip(idx[a:b], val[a:b], strict=True))
        want += sum(float(m.v[idx[i]] @ m.v[idx[j]]) * val[i] * val[j] for i in range(a, b) for j in range(i + 1, b))
        assert z[d] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_quality_edges(spark):
    d = clashing(docs(spark, EDGES)).drop("score")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (4, None, None), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.score(d, quality.train(d, lab)).collect()
        assert len(rows) == len(EDGES)
        assert all(0 <= r["score"] <= 1 for r in rows)
    model = quality.train(d, labels)
    assert quality.score(d.limit(0), model).count() == 0
    assert quality.keep_good(d, model, 0.0).count() == len(EDGES)
    assert quality.keep_good(d, model, 1.1).count() == 0
    assert quality.score(d, model).collect() == quality.score(d, quality.train(d, labels)).collect()


def test_quality_model_does_not_depend_on_the_order_of_rows(spark):
    d = docs(spark, ["one text", "two texts"]).union(docs(spark, ["another text", "yet another"])).union(docs(spark, ["third", None]))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "doc_id bigint, quality int")
    models = [quality.train(d.repartition(n), labels) for n in (1, 2, 3, 7)]
    assert all((m.w == models[0].w).all() and (m.v == models[0].v).all() and m.w0 == models[0].w0 for m in models)


def plain_ids(texts, specials=True):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    tok.encode_special_tokens = not specials
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["A <|endoftext|>B<|startoftext|> x<|EndOfText|>Y <|ENDOFTEXT|>", "J\u030cx j\u030c, a b é— — ,'s don't I'LL 12ab", "<|endoftext|> a<|startoftext|>b", "ÀÉ\u0301! \x1c x\x1dy ǅ ß… 日本語 １２ ²½ \u200b\u200d", "İa ŉx ĸ Ŀ İ", "word, Word. word### don't. it's, x'y", "''' ''s 'S", "a\u00a0b\u2003c\u0085d"]


def test_word_encoder_equals_the_tokenizer():
    enc = orc_tokens.WordEncoder(Q.tokenizer_path("word_bpe_49k.json"))
    rnd = random.Random(4)
    alphabet = "abcXYZéÉßøñ'’,.!#|-12 \n\t—…日\u0301ſK"
    texts = [*ODD, *EDGES, *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]]
    ids, n = enc.encode([None if t is None else t.encode() for t in texts], 7)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*x, 7] for x in plain_ids(texts)]
    plain, n_plain = orc_tokens.WordEncoder(Q.tokenizer_path("word_bpe_49k.json"), specials=False).encode([(t or "").encode() for t in texts], 7)
    assert [x.tolist() for x in np.split(plain, np.cumsum(n_plain)[:-1])] == [[*x, 7] for x in plain_ids(texts, specials=False)]
    small = orc_tokens.WordEncoder(Q.tokenizer_path("word_bpe_49k.json"))
    orc_tokens.PART, part = 50, orc_tokens.PART
    orc_tokens.MEMO, memo = 5, orc_tokens.MEMO
    try:
        again, m = small.encode([None if t is None else t.encode() for t in texts], 7)
    finally:
        orc_tokens.PART, orc_tokens.MEMO = part, memo
    assert (again == ids).all() and (m == n).all()


def test_words_are_looked_up_once_in_a_part():
    """However often a word occurs, and whatever punctuation stands behind it."""

    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

    enc = orc_tokens.WordEncoder(Q.tokenizer_path("word_bpe_49k.json"))
    enc.memo = Asked(enc.memo)
    text = "straße, Abc. abc, abc 12 " * 2_000
    ids, n = enc.encode([text.encode(), b"abc!"], 1)
    assert [x.tolist() for x in np.split(ids, n[:1])] == [[*x, 1] for x in plain_ids([text, "abc!"])]
    assert Asked.n < 20
    assert set(enc.memo) - {b""} == {"straße".encode(), b"abc", b"12", b",", b".", b"!"}


def test_orc_round_trip(spark, tmp_path):
    d = clashing(docs(spark, [*EDGES, *ODD])).repartition(3)
    path = (tmp_path / "tokens").as_uri()
    orc_tokens.write_tokens(d, path, Q.tokenizer_path("word_bpe_49k.json"))
    want = [[*x, 1] for x in plain_ids([*EDGES, *ODD])]
    rows = orc_tokens.read_tokens(spark, path).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    crc = orc_tokens.checksums(spark, path).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in crc] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert [(r["start"], r["n_tokens"]) for r in crc] == [(r["start"], r["n_tokens"]) for r in rows]
    assert orc_tokens.read_tokens(spark, path).where("doc_id = 3").first()["ids"] == want[3]


def test_orc_files_are_written_by_the_tasks_that_encode(spark, tmp_path):
    """Rows with ids never go through a JVM writer, and failed tasks leave no files among the whole ones."""
    path = tmp_path / "tokens"
    d = docs(spark, ["a b"] * 5_000).repartition(4)
    orc_tokens.write_tokens(d, path.as_uri(), Q.tokenizer_path("word_bpe_49k.json"))
    files = list(path.iterdir())
    assert files and all(f.suffix == ".orc" for f in files)  # no checksums or marks of Hadoop's
    assert all(ORCFile(f).compression == "ZSTD" and ORCFile(f).row_index_stride == 1_000 for f in files)
    jvm = spark._jvm.org.apache.orc.OrcFile
    reader = jvm.createReader(spark._jvm.org.apache.hadoop.fs.Path(files[0].as_uri()), jvm.readerOptions(spark._jsc.hadoopConfiguration()))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    assert {s.getColumn() for s in streams if str(s.getKind()) == "BLOOM_FILTER_UTF8"} == {1}
    got = orc_tokens.read_tokens(spark, path.as_uri()).where("doc_id = 4321")
    assert [r["start"] for r in got.collect()] == [4321 * 3]
    with pytest.raises(FileExistsError):
        orc_tokens.write_tokens(d, path.as_uri(), Q.tokenizer_path("word_bpe_49k.json"))
    broken = docs(spark, ["a b"]).withColumn("text", F.expr("raise_error('x')"))
    with pytest.raises(Exception, match="x"):
        orc_tokens.write_tokens(broken, (tmp_path / "broken").as_uri(), Q.tokenizer_path("word_bpe_49k.json"))
    assert orc_tokens.checksums(spark, (tmp_path / "broken").as_uri()).count() == 0


def test_orc_repeated_null_and_no_rows(spark, tmp_path):
    d = docs(spark, ["a", "b b"]).union(docs(spark, ["a", "b b"])).union(spark.createDataFrame([(None, "x", None, None, None)], DOCS))
    path = (tmp_path / "tokens").as_uri()
    orc_tokens.write_tokens(d, path, Q.tokenizer_path("word_bpe_49k.json"))
    rows = sorted(orc_tokens.checksums(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 0, 1, 1]
    orc_tokens.write_tokens(d.limit(0), path + "-none", Q.tokenizer_path("word_bpe_49k.json"))
    assert orc_tokens.checksums(spark, path + "-none").count() == 0


def test_orc_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = [[*x, 1] for x in plain_ids([r["text"] for r in rows])]
    got = Q.op3_orc_tokens(spark, sf).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, want, strict=True)]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_stripes_are_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(orc_tokens.ORC_OPTIONS, "orc.stripe.size", "1024")
    monkeypatch.setattr(orc_tokens, "TASK_BYTES", 1_000)
    path = (tmp_path / "tokens").as_uri()
    rnd = random.Random(1)
    d = docs(spark, [" ".join(str(rnd.random()) for _ in range(5)) for _ in range(60_000)])
    orc_tokens.write_tokens(d, path, Q.tokenizer_path("word_bpe_49k.json"))
    rows = orc_tokens.checksums(spark, path)
    sizes = orc_tokens.read_stripes(spark, path, lambda b: b.select(["doc_id"]), "doc_id bigint", ("doc_id",)).rdd.glom().map(len).collect()
    assert rows.count() == 60_000 == sum(sizes)
    files = [f for f in (tmp_path / "tokens").iterdir() if f.suffix == ".orc"]
    assert len(sizes) > len(files) and min(sizes) > 0


def tiktoken_of(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("t", pat_str=Q.pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [200, 32 << 20])
def test_bpe_equals_the_library(spark, block):
    path = Q.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    texts = [*EDGES, *ODD, "It's  two\n\n spaces \t end  ", "<|endoftext|>"]
    d = clashing(docs(spark, texts)).union(clashing(docs(spark, ["a", None]))).repartition(3)
    rows = bpe.encode(d, path, Q.pattern(), block_bytes=block).collect()
    enc = tiktoken_of(path)
    want = dict(enumerate(texts))
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = want[r["doc_id"]] if r["doc_id"] > 1 else None
        if t is not None:
            assert r["ids"] == enc.encode_ordinary(t)
            assert bytes(r["decoded"]) == t.encode()
    assert bpe.encode(d.limit(0), path, Q.pattern()).count() == 0


def test_bpe_pieces_do_not_pass_through_the_jvm(spark, tmp_path, monkeypatch):
    """Python tasks write them, two files a block, and no table is left in the catalog; a block may have no words."""
    for i, texts in enumerate([["a b", "b c"] * 20, [None, ""]]):
        monkeypatch.setattr(bpe, "fresh_path", lambda spark, name, i=i: (tmp_path / f"{name}-{i}").as_uri())
        rows = bpe.encode(docs(spark, texts).coalesce(1), Q.tokenizer_path("byte_bpe_multi_50k.tiktoken"), Q.pattern())
        assert sorted(f.suffix for f in (tmp_path / f"pieces-{i}").iterdir()) == [".docs", ".words"]
        assert {r["doc_id"]: bytes(r["decoded"]) for r in rows.collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lacuna_")]


def test_bpe_query(spark, sf):
    enc = tiktoken_of(Q.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op9_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def plain_hits(items, text, window):
    words, hit, keys = decontam.words_of(text), set(), set()
    for key, t in items:
        x = decontam.words_of(t)
        n = min(window, len(x))
        if key is None or not n:
            continue
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                keys.add(key)
    return len(words), len(hit), keys


@pytest.mark.parametrize("block", [4, 10_000])
def test_decontamination_equals_brute_force(spark, block):
    rnd = random.Random(block)
    items = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7)))) for i in range(4)] + [(None, "a b c"), (9, None), (2, "d d A")]
    texts = ["-".join(rnd.choice("abcdxY") for _ in range(rnd.randint(0, 30))) for _ in range(25)] + [None, "", "!!"]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = clashing(docs(spark, texts))
    rows = decontam.match(d, b, window=3, block_words=block).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), set(r["items"])) == plain_hits(items, t, 3)
    cleaned = {r["doc_id"]: r["text"] for r in decontam.clean(d, b, window=3, block_words=block, max_coverage=0.9).collect()}
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        n = sum(s["end"] - s["start"] for s in r["spans"])
        if n > 0.9 * r["n_words"]:
            assert i not in cleaned
        elif not n:
            assert cleaned[i] == t
        else:
            assert len(decontam.words_of(cleaned[i])) == r["n_words"] - n


def test_texts_pass_the_blocks_in_groups(spark):
    words = [f"w{i}" for i in range(400)]
    b = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(0, 380, 20)], "item_id bigint, text string")
    d = docs(spark, [" ".join(words[i : i + 30]) for i in range(0, 370, 3)])
    want = decontam.match(d, b).orderBy("doc_id").collect()
    assert sum(len(r["items"]) for r in want) > 50
    for size in (1, 2_000, 1 << 30):
        found = decontam.match(d, b, block_words=40, group_bytes=size)
        assert found.orderBy("doc_id").collect() == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
        cleaned = {r["doc_id"]: r["text"] for r in decontam.clean(d, b, block_words=40, group_bytes=size).collect()}
        assert cleaned == {r["doc_id"]: r["text"] for r in decontam.clean(d, b).collect()}


def test_decontamination_edges(spark):
    d, b = docs(spark, EDGES), spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.digest(decontam.match(d, b)).where("contaminated").count() == 0
    assert decontam.match(d.limit(0), b).count() == 0
    assert decontam.clean(d, b).count() == len(EDGES)
    text = "one two three four five six seven eight nine ten eleven"
    b = spark.createDataFrame([(1, text), (2, "Short item!")], "item_id bigint, text string")
    d = docs(spark, [f"Start. {text.upper()} end of it, and then some more words, as many as that", "a short item here", "short"])
    rows = decontam.digest(decontam.match(d, b)).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"]) for r in rows] == [(11, 1), (2, 1), (0, 0)]
    out = {r["doc_id"]: r["text"] for r in decontam.clean(d, b).collect()}
    assert out[0] == "Start.  end of it, and then some more words, as many as that"


def test_html_queries(spark, sf):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = Q.op7_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"], re.S)[1]).replace("<br>", " ")
        want = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", article)) if t)
        assert r["text"] == want
        assert r["n_chars"] == len(want)


WEIGHTS = html_text.fit(html_text.labelled_pages())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><script>x", ""),
        ("plain words only here", "plain words only here"),
        ("<p>a &lt;b&gt; &amp; c&#33;</p><p>two\n  lines</p>", "a <b> & c!\ntwo lines"),
        ("<article><h1>T</h1><p>one two three</p><div class='ad'>buy now</div><p>four five six</p></article>", "T\none two three\nfour five six"),
        ("<main><p>first para of text</p><form><input><button>Send</button></form><p>second para of text</p></main><section id='comments'><p>nice post</p></section>", "first para of text\nsecond para of text"),
        ("<div class='sidebar'><a href=x>l</a></div><div><p>body text is here<p>and here</div><footer>foot</footer>", "body text is here\nand here"),
        ("<p>a<br>b <b>c</b>d</p><!-- <p>no</p> --><p>e", "a b cd\ne"),
        ("<ul><li>one and two<li>two or three</ul><table><tr><td>x to y<td>y to z<tr><td>more of it<td>and the rest</table>", "one and two\ntwo or three\nx to y\ny to z\nmore of it\nand the rest"),
        ("<p>cut off <a href='", "cut off"),
    ],
)
def test_html_cases(page, want):
    assert html_text.text_of(page, WEIGHTS) == want


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x"), (2, "u", "<b>" * 2000 + "deep" + "</b>" * 2000), (3, "u", "<p>word " * 20_000)], "page_id bigint, url string, html string")
    rows = html_text.extract(clashing(pages).withColumn("text", pages.url)).collect()
    assert len(rows) == 5
    assert {r["page_id"]: r["n_chars"] for r in rows}[2] == 4
    assert max(r["n_chars"] for r in rows) == 20_000 * 5 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


def test_region_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(200):
        toks = [("word" if rnd.random() < 0.5 else "<x>", rnd.randint(1, 4), "w") for _ in range(rnd.randint(1, 12))]
        w = {"word": 1.0, "<x>": -2.0}
        value = lambda t: w[t[0]] * (t[1] if t[0][0] == "w" else 1)
        best = max([0.0, *(sum(map(value, toks[a:b])) for a in range(len(toks)) for b in range(a + 1, len(toks) + 1))])
        a, b = html_text.region(toks, w)
        assert sum(map(value, toks[a:b])) == pytest.approx(best)


def said(head, n):
    return " ".join(f"{head}{i}" for i in range(n))


@pytest.mark.parametrize("beside", ["<div class=related><p>{}</p></div>", "<aside><div><div>{}</div></div></aside>", "<section id=newsletter><ul><li>{}</li></ul></section>"])
@pytest.mark.parametrize(("lead", "tail"), [(20, 300), (300, 5)])
def test_html_long_asides_do_not_split_the_article(beside, lead, tail):
    page = f"<article><h1>Head</h1><p>{said('lead', lead)}</p>{beside.format(said('beside', 900))}<p>{said('tail', tail)}</p></article>"
    assert html_text.text_of(page, WEIGHTS) == f"Head\n{said('lead', lead)}\n{said('tail', tail)}"


@pytest.mark.parametrize("box", ["<div class='{}'><ul>{}</ul></div>", "<div class='{}'><div>{}</div></div>"])
def test_html_unmarked_links_are_not_the_article(box):
    links = lambda head: "".join(f"<li><a href=/{i}>{head} {i}</a></li>" for i in range(12))
    page = f"<body>{box.format('top-links', links('Go'))}<div><h1>Head</h1><p>{said('body', 40)} <a href=x>a link</a> {said('more', 9)}</p></div>{box.format('bottom', links('Foot'))}</body>"
    assert html_text.text_of(page, WEIGHTS) == f"Head\n{said('body', 40)} a link {said('more', 9)}"


def test_html_words_score_positive_and_tags_negative():
    assert WEIGHTS["word"] > 0 and WEIGHTS["beside"] < 0
    assert all(w < 0 for k, w in WEIGHTS.items() if k[0] == "<" and k != html_text.END_TAG)


def test_html_the_scan_decides(spark, sf, monkeypatch):
    """Without the scan, or with weights that say nothing, the article is not found: on the test pages, nor where nothing is marked."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    links = "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(9))
    pages.append(f"<div><ul>{links}</ul></div><div><h1>Head</h1><p>{said('body', 30)}</p></div><div><div>{links}</div></div>")
    right = [html_text.text_of(p, WEIGHTS) for p in pages]
    assert right[-1] == f"Head\n{said('body', 30)}"
    even = {k: float(k[0] != "<") for k in WEIGHTS}
    assert all(html_text.text_of(p, even) != t for p, t in zip(pages, right, strict=True))
    monkeypatch.setattr(html_text, "region", lambda tokens, _: (0, len(tokens)))
    assert all(html_text.text_of(p, WEIGHTS) != t for p, t in zip(pages, right, strict=True))


@pytest.mark.parametrize("page", ["<b>{0}</b>", "{1}{2}", "<i><div>{1}{3}", "<table>{4}", "{5}>"])
def test_html_deep_pages_take_linear_time(page):
    import time

    def took(n):
        text = page.format("x", "<b>" * n, "<p>x" * n, "</i>" * n, "<tr><td>x" * n, "<é" * n)
        best = 9.0
        for _ in range(2):
            at = time.perf_counter()
            html_text.text_of(text, WEIGHTS)
            best = min(best, time.perf_counter() - at)
        return best

    assert took(64_000) < max(0.2, 20 * took(8_000))  # 64 times if it were quadratic
