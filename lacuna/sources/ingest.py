"""Fetching a corpus: cached pages, a manifest that guards them, and the corpus made of them.

Pages follow each other by cursor, so their loop is the driver's; the works in them are normalised, cut and
de-duplicated as a distributed job over the cached pages.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.client import MIN_REMAINING_USD, BudgetExhausted, page_body
from lacuna.sources.corpus import WORKS_FILE, normalise_pages, number_rows, parse_pages, truncate_dedup, write_works_file
from lacuna.sources.files import Folder

QUERY_FILE, RAW = "query.json", "raw"
#: 1: without abstracts, 2: with abstracts, 3: with topics.
FETCH_SCHEMA, LEGACY_SCHEMA = 3, 1
SUMMARY = "pages bigint, cached_pages bigint, fetched_pages bigint, works bigint, cost_usd double, stopped_by_budget boolean, duplicates bigint, reported_total bigint"


class IngestError(Exception):
    """The data folder can't be used for this query."""


class QueryMismatch(IngestError):
    pass


class OrphanCache(IngestError):
    pass


class BadPage(IngestError):
    pass


@dataclass(frozen=True)
class FetchParams:
    query: str
    filter: str | None = None
    limit: int = 2000
    schema: int = FETCH_SCHEMA

    def same_pages(self, other: FetchParams) -> bool:
        return (self.query, self.filter, self.schema) == (other.query, other.filter, other.schema)


def page_path(index: int) -> str:
    """Where a page is within the data folder."""
    return f"{RAW}/page-{index:04}.json"


def check_manifest(folder: Folder, params: FetchParams) -> None:
    """Write the manifest, or make sure that cached pages are those of this query; the limit may change."""
    cached = folder.any(f"{RAW}/page-*.json")
    if not folder.exists(QUERY_FILE):
        if cached:
            raise OrphanCache(f"{folder.path} has cached pages but no {QUERY_FILE}; delete {RAW}/ or use another folder")
    else:
        said = json.loads(folder.read(QUERY_FILE))
        old = FetchParams(said["query"], said.get("filter"), said["limit"], said.get("schema", LEGACY_SCHEMA))
        if cached and not old.same_pages(params):
            raise QueryMismatch(f"{folder.of(QUERY_FILE)} is of another query ({old}, asked for {params}); use another folder")
        if old == params:
            return
    folder.replace(QUERY_FILE, [json.dumps({"query": params.query, "filter": params.filter, "limit": params.limit, "schema": params.schema}, indent=2, ensure_ascii=False)])


def fetch(spark: SparkSession, client, data_dir: str, params: FetchParams) -> DataFrame:
    """Fetch until ``limit`` works with an id are there, write the corpus, and give the one-row summary.

    On a cluster ``data_dir`` is a folder that executors share, as the cached pages are read by them.
    """
    folder = Folder(spark, data_dir)
    check_manifest(folder, params)
    cursor, index, got, cached, cost, stopped, total = "*", 0, 0, 0, 0.0, False, None
    while cursor is not None and got < params.limit:
        path = page_path(index)
        left = None
        known = folder.exists(path)
        if known:
            text, hint = folder.read(path), "; delete it and run again"
        else:
            try:
                page = client.fetch_page(params.query, params.filter, cursor)
            except BudgetExhausted:
                if not got:
                    raise  # a corpus is never replaced by an empty one
                stopped = True
                break
            text, left, hint = page.body, page.remaining_usd, ""
            cost += page.cost_usd or 0.0
        try:
            body = page_body(text)
        except ValueError as e:
            raise BadPage(f"{folder.of(path)}: not a page of works{hint}") from e
        if known:
            cached += 1
        else:
            folder.replace(path, [text])
        index += 1
        meta = body.get("meta") or {}
        total = meta.get("count") if meta.get("count") is not None else total
        results = body["results"] or []
        got += sum(r.get("id") is not None for r in results)
        cursor = meta.get("next_cursor") if results else None
        if left is not None and left < MIN_REMAINING_USD and cursor is not None and got < params.limit:
            stopped = True
            break
    works = corpus_of(spark, data_dir, params.limit, index)
    rows = works.orderBy("ord").drop("ord")
    n = write_works_file((r.asDict(recursive=True) for r in rows.toLocalIterator()), folder, WORKS_FILE)
    summary = (index, cached, index - cached, n, cost, stopped, min(got, params.limit) - n, total)
    return spark.createDataFrame([summary], SUMMARY)


def corpus_of(spark: SparkSession, data_dir: str, limit: int, pages: int | None = None) -> DataFrame:
    """The works of the first cached pages."""
    raw = parse_pages(spark, f"{data_dir}/{RAW}/page-*.json")
    raw = raw if pages is None else raw.where(F.col("page") < pages)
    return truncate_dedup(number_rows(normalise_pages(raw)), limit)
