from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna import cli
from lacuna.report import render
from lacuna.sources import client as api
from lacuna.sources import ingest
from lacuna.sources.corpus import abstract_of, load_corpus, read_works, write_works
from lacuna.sources.files import CHUNK, Folder
from lacuna.sources.schema import ID_PREFIX
from lacuna.streaming.pages import land
from tests.corpora import frame, work


def result(i, **more):
    return {"id": f"{ID_PREFIX}W{i}", "display_name": f"Work {i}", "publication_year": 2020, "cited_by_count": None, "referenced_works": [f"{ID_PREFIX}W1"], "concepts": [], "topics": None, "abstract_inverted_index": None} | more


def page(ids, cursor, count=9):
    return json.dumps({"meta": {"count": count, "next_cursor": cursor}, "results": [result(i) for i in ids]})


class Fake:
    def __init__(self, pages, left=1.0):
        self.pages, self.asked, self.left = pages, [], left

    def fetch_page(self, query, filter, cursor):
        self.asked.append(cursor)
        return api.FetchedPage(self.pages[cursor], 0.001, self.left)


PAGES = {"*": page([1, 2], "c2"), "c2": page([2, 3], "c3"), "c3": page([4], None)}


@pytest.mark.parametrize(
    ("index", "want"),
    [({"no": [0, 2], "rain": [1], "river": [3]}, "no rain no river"), ({"a": [0], "b": [5]}, "a b"), ({}, None), ({"a": []}, None), ({"a": [1 << 62]}, None), ({"b": [0], "a": [0]}, "b"), (None, None)],
)
def test_abstracts(spark, index, want):
    df = spark.createDataFrame([(index,)], T.StructType([T.StructField("x", T.MapType(T.StringType(), T.ArrayType(T.LongType())))]))
    assert df.select(abstract_of(F.col("x"))).first()[0] == want


def test_fetch_caches_resumes_and_dedups(spark, tmp_path):
    fake = Fake(PAGES)
    s = ingest.fetch(spark, fake, str(tmp_path), ingest.FetchParams("q")).first()
    assert (s["pages"], s["cached_pages"], s["works"], s["duplicates"], s["reported_total"]) == (3, 0, 4, 1, 9)
    assert fake.asked == ["*", "c2", "c3"]
    works = load_corpus(spark, str(tmp_path))
    assert [r["id"] for r in works.orderBy("ord").collect()] == ["W1", "W2", "W3", "W4"]
    assert works.first()["cited_by_count"] == 0
    again = Fake(PAGES)
    s = ingest.fetch(spark, again, str(tmp_path), ingest.FetchParams("q", limit=3)).first()
    assert (again.asked, s["cached_pages"], s["works"], s["duplicates"]) == ([], 2, 2, 1)
    with pytest.raises(ingest.QueryMismatch):
        ingest.fetch(spark, again, str(tmp_path), ingest.FetchParams("other"))
    (tmp_path / ingest.QUERY_FILE).unlink()
    with pytest.raises(ingest.OrphanCache):
        ingest.fetch(spark, again, str(tmp_path), ingest.FetchParams("q"))


def test_fetch_stops_at_the_budget(spark, tmp_path):
    s = ingest.fetch(spark, Fake(PAGES, left=0.001), str(tmp_path), ingest.FetchParams("q")).first()
    assert (s["pages"], s["stopped_by_budget"]) == (1, True)

    class Broke:
        def fetch_page(self, *_):
            raise api.BudgetExhausted("none left")

    with pytest.raises(api.BudgetExhausted):
        ingest.fetch(spark, Broke(), str(tmp_path / "new"), ingest.FetchParams("q"))


def test_bad_pages(spark, tmp_path):
    with pytest.raises(ingest.BadPage):
        ingest.fetch(spark, Fake({"*": '{"error": 1}'}), str(tmp_path), ingest.FetchParams("q"))
    assert not (tmp_path / "works.jsonl").exists()
    s = ingest.fetch(spark, Fake({"*": '{"results": null}'}), str(tmp_path), ingest.FetchParams("q")).first()
    assert s["works"] == 0


def test_normalised_fields(spark, tmp_path):
    full = result(1, concepts=[{"id": f"{ID_PREFIX}C1", "display_name": "Harbour", "level": 2, "score": 0.5}, {"id": "C2", "display_name": None, "level": 1, "score": 0.1}], topics=[{"id": "T1", "display_name": "T", "score": 0.9, "field": {"display_name": "Engineering"}}], abstract_inverted_index={"x": [0]})
    body = json.dumps({"results": [full, {"display_name": "no id"}]})
    ingest.fetch(spark, Fake({"*": body}), str(tmp_path), ingest.FetchParams("q"))
    w = load_corpus(spark, str(tmp_path)).collect()
    assert len(w) == 1
    assert [tuple(c) for c in w[0]["concepts"]] == [("C1", "Harbour", 2, 0.5)]
    assert w[0]["topics"][0]["field"] == "Engineering"
    assert (w[0]["abstract"], w[0]["referenced_works"]) == ("x", ["W1"])


def test_stream_lands_pages(spark, tmp_path):
    ingest.fetch(spark, Fake(PAGES), str(tmp_path), ingest.FetchParams("q"))
    q = land(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (tmp_path / "raw" / "page-0003.json").write_text(page([7], None))
    land(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_corpus_round_trip_and_errors(spark, tmp_path):
    w = frame(spark, [work(i, labels="AB", refs=["W0"], abstract="x" if i else None) for i in range(4)])
    write_works(w, str(tmp_path / "c"))
    assert sorted(map(str, read_works(spark, str(tmp_path / "c")).drop("ord").collect())) == sorted(map(str, w.drop("ord").collect()))
    old = tmp_path / "old.jsonl"
    old.write_text('{"id":"W1","title":null,"year":2000,"cited_by_count":1,"referenced_works":[],"concepts":[]}\n\n')
    r = read_works(spark, str(old)).collect()
    assert (len(r), r[0]["topics"], r[0]["abstract"]) == (1, [], None)
    old.write_text('\n{"id":"W1"}\n')
    with pytest.raises(Exception, match="old.jsonl:2: not a work"):
        read_works(spark, str(old)).collect()
    with pytest.raises(FileNotFoundError, match="run fetch first"):
        load_corpus(spark, str(tmp_path / "none"))


class Server:
    def __init__(self, answers):
        seen = self.seen = []

        class H(BaseHTTPRequestHandler):
            def do_GET(self):
                seen.append(self.path)
                status, headers, body = answers[min(len(seen), len(answers)) - 1]
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), H)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/works"


def test_client_retries_then_succeeds():
    s, waits = Server([(503, {"Retry-After": "7"}, ""), (200, {"x-ratelimit-cost-usd": "0.002"}, "{}")]), []
    c = api.HttpClient("key", s.url, sleep=waits.append)
    got = c.fetch_page("a b", "f:1", "*")
    assert (got.body, got.cost_usd, got.remaining_usd) == ("{}", 0.002, None)
    assert 7.0 in waits
    assert "search=a+b" in s.seen[0]
    assert "api_key=key" in s.seen[0]


def test_client_errors():
    c = api.HttpClient("secret", Server([(400, {"x-ratelimit-remaining-usd": "0"}, "bad \x1b secret")]).url, sleep=lambda _: None)
    with pytest.raises(api.ApiError, match=r"status 400: bad   \*\*\*"):
        c.fetch_page("q", None, "*")
    c = api.HttpClient(None, Server([(429, {"x-ratelimit-remaining-usd": "0.001"}, "")]).url, sleep=lambda _: None)
    with pytest.raises(api.BudgetExhausted):
        c.fetch_page("q", None, "*")


def test_works_api_source(spark):
    """Each query's pages until its limit, the end of its chain, or the end of the budget."""
    spark.dataSource.register(api.WorksDataSource)
    read = lambda url, queries, **more: spark.read.format("works_api").options(queries=queries, url=url, **more).load()
    chain = [(200, {}, PAGES["*"]), (200, {}, PAGES["c2"]), (200, {}, PAGES["c3"])]
    rows = read(Server(chain).url, "q").collect()  # one pass: a sort would ask twice
    assert [(r["query"], r["page"], len(json.loads(r["body"])["results"])) for r in rows] == [("q", 0, 2), ("q", 1, 2), ("q", 2, 1)]
    assert read(Server(chain).url, "q", limit="3").count() == 2
    poor = {"x-ratelimit-remaining-usd": "0.001"}
    assert read(Server([chain[0], (429, poor, "")]).url, "q").count() == 1
    assert read(Server([(200, poor, PAGES["*"]), *chain]).url, "q").count() == 1
    with pytest.raises(Exception, match="USD left"):
        read(Server([(429, poor, "")]).url, "q").collect()
    assert read("http://127.0.0.1:9", "").count() == 0


def test_folder(spark, tmp_path):
    for path in (str(tmp_path / "a b"), (tmp_path / "c").as_uri()):
        f = Folder(spark, path)
        assert not f.exists("x/y.json")
        assert not f.any("x/*.json")
        f.replace("x/y.json", ["é", "b" * CHUNK, "c"])
        f.replace("x/y.json", ["é", "z\n"])
        assert (f.read("x/y.json"), f.any("x/*.json"), f.any("x/*.tmp")) == ("éz\n", True, False)
    assert [p.name for p in (tmp_path / "c" / "x").iterdir()] == ["y.json"]
    with pytest.raises(ZeroDivisionError):
        f.replace("x/y.json", (str(1 / i) for i in (1, 0)))
    assert f.read("x/y.json") == "éz\n"


def test_retry_delay_and_sanitiser():
    assert [api.retry_delay(i, None) for i in range(3)] == [1, 2, 4]
    assert (api.retry_delay(0, "99"), api.retry_delay(1, "Wed, 21 Oct 2015"), api.retry_delay(30, None)) == (60, 2, 60)
    assert len(api.sanitised("x" * 600, None)) == 501


def test_render(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("lift", T.DoubleType()), T.StructField("n", T.LongType(), True, {"header": "count"}), T.StructField("s", T.StringType(), True, {"skip": True})])
    df = spark.createDataFrame([('x, "y"', 0.12345, 1, "z"), (None, None, None, None)], schema).coalesce(1)
    assert render(df, "csv") == 'a,lift,count\n"x, ""y""",0.123,1\n,,\n'
    assert render(df, "table") == 'a       lift   count\n------  -----  -----\nx, "y"  0.123  1\n\n'
    assert json.loads(render(df, "json"))[0] == {"a": 'x, "y"', "lift": 0.12345, "n": 1, "s": "z"}
    with pytest.raises(ValueError, match="precision"):
        render(spark.createDataFrame([], T.StructType([T.StructField("a", T.StringType(), True, {"precision": 2})])))


def cli_corpus(tmp_path):
    rows = [
        {"id": "W1", "title": "One, first", "year": 2021, "referenced_works": ["W2"], "topics": ["Battery", "Electrolyte"]},
        {"id": "W2", "title": "Two", "year": 2022, "referenced_works": [], "topics": ["Battery"]},
        {"id": "W3", "title": "Three", "year": 2023, "referenced_works": ["W1", "W2"], "topics": ["Electrolyte"]},
    ]
    for r in rows:
        r["topics"] = [{"id": f"T-{t}", "name": t, "score": 0.9, "subfield": None, "field": None, "domain": None} for t in r["topics"]]
        r |= {"cited_by_count": 1, "concepts": [{"id": "C1", "name": "Apple", "level": 2, "score": 0.5}], "abstract": None}
    (tmp_path / "works.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(capsys, tmp_path, *args):
    code = cli.main(["--data", str(tmp_path), *args])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_cli(spark, tmp_path, capsys):
    cli_corpus(tmp_path)
    code, out, _ = run(capsys, tmp_path, "--format", "csv", "stats")
    assert (code, out.split("\n")[1]) == (0, "3,2021,2023,3,3,1.0000,2,1,0")
    _, out, _ = run(capsys, tmp_path, "citations", "--format", "csv")
    assert out.startswith("rank,id,title,year,pagerank,in_corpus_citations,cited_by_count\n1,W2,Two,2022,")
    _, out, _ = run(capsys, tmp_path, "concepts", "--format", "json")
    assert [r["concept"] for r in json.loads(out)] == ["Battery", "Electrolyte"]
    _, out, _ = run(capsys, tmp_path, "gaps", "--bridges", "2", "--format", "csv")
    assert out == "rank,concept_a,concept_b,works_a,works_b,observed,expected,lift,bridges\n"
    _, out, err = run(capsys, tmp_path, "backtest", "--split-year", "2021", "--summary", "--format", "csv")
    assert len(out.splitlines()) == 8
    assert "train 1 works" in err
    _, out, err = run(capsys, tmp_path, "evaluate", "--split-year", "2021", "--null-permutations", "0", "--format", "csv")
    assert len(out.splitlines()) == 8
    assert "no baseline" in err
    _, _, err = run(capsys, tmp_path, "verify", "--taxonomy", "topics", "--alias", "x=y")
    assert all(x in err for x in ("has an abstract", "fits no label", "long phrases"))
    _, _, err = run(capsys, tmp_path, "evidence", "--a", "Apple", "--b", "Nothing")
    assert "'Nothing' is not a label" in err
    code, _, err = run(capsys, tmp_path / "none", "stats")
    assert (code, "run fetch first" in err) == (1, True)
    with pytest.raises(SystemExit) as e:
        cli.main(["gaps", "--min-score", "2"])
    assert e.value.code == 2


def test_registered_pages_and_dedup_take_every_row(spark, tmp_path):
    from lacuna.plans import queries as plans
    from lacuna.sources.corpus import truncate_dedup

    n = 12_000
    spark.range(n).selectExpr("id as o_orderkey", "id % 7000 as o_custkey", "date'2020-01-01' as o_orderdate", "1.5 as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    pages = plans.queries()["api_pages"](spark, str(tmp_path)).selectExpr("count(*) as n", "max(ord) as last").first()
    assert tuple(pages) == (n - n // 10, n - n // 10 - 1)
    assert sorted(r["ord"] for r in plans.queries()["dedup_works"](spark, str(tmp_path)).collect()) == list(range(7000))
    # A limit comes before the de-duplication.
    w = frame(spark, [work(0, "a"), work(1, "a"), work(2, "b"), work(3, "c")])
    assert sorted(r["id"] for r in truncate_dedup(w, 3).collect()) == ["a", "b"]
    assert sorted(r["id"] for r in truncate_dedup(w, None).collect()) == ["a", "b", "c"]
