"""Pages of a cursor-paged works API: client, pace, retries, and a batch source for Spark."""

from __future__ import annotations

import json
import time
import unicodedata
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The address and the fields asked for.
WORKS_URL = "https://api.openalex.org/works"
SELECT = "id,display_name,publication_year,cited_by_count,referenced_works,concepts,topics,abstract_inverted_index"
PER_PAGE = 200
MIN_INTERVAL_S, TIMEOUT_S, MAX_RETRIES, MAX_DELAY_S = 0.1, 60, 3, 60
MIN_REMAINING_USD = 0.01
MAX_ERROR_CHARS = 500


class ApiError(Exception):
    """The API refused a request."""


class BudgetExhausted(ApiError):
    """What is left to spend does not pay for another request."""


@dataclass
class FetchedPage:
    body: str
    cost_usd: float | None = None
    remaining_usd: float | None = None


def retry_delay(attempt: int, retry_after: str | None) -> float:
    """Seconds to wait: what the server says in whole seconds, else 1, 2, 4, ...; never more than a minute."""
    said = (retry_after or "").strip().removeprefix("+")
    seconds = int(said) if said.isascii() and said.isdigit() else 2 ** min(attempt, 10)
    return float(min(seconds, MAX_DELAY_S))


def sanitised(body: str, api_key: str | None) -> str:
    """What of an error's body goes into a message: without the key, control characters, and all beyond a limit."""
    text = body.replace(api_key, "***") if api_key else body
    shown = "".join(" " if unicodedata.category(c) == "Cc" else c for c in text[:MAX_ERROR_CHARS])
    return shown + "…" * (len(text) > MAX_ERROR_CHARS)


def _number(headers, name: str) -> float | None:
    try:
        return float(headers.get(name).strip())
    except (AttributeError, ValueError):
        return None


class HttpClient:
    """``fetch_page(query, filter, cursor)`` over HTTP, at most one request in each interval."""

    def __init__(self, api_key: str | None = None, url: str = WORKS_URL, sleep: Callable[[float], None] = time.sleep, log: Callable[[str], None] = lambda _: None):
        self.api_key, self.url, self.sleep, self.log = api_key, url, sleep, log
        self.last: float | None = None

    def throttle(self) -> None:
        if self.last is not None and (left := MIN_INTERVAL_S - (time.monotonic() - self.last)) > 0:
            self.sleep(left)
        self.last = time.monotonic()

    def params(self, query: str, filter: str | None, cursor: str) -> list[tuple[str, str]]:
        out = [("search", query)]
        if filter is not None:
            out.append(("filter", filter))
        out += [("per-page", str(PER_PAGE)), ("cursor", cursor), ("select", SELECT)]
        return out + ([("api_key", self.api_key)] if self.api_key is not None else [])

    def fetch_page(self, query: str, filter: str | None, cursor: str) -> FetchedPage:
        url = f"{self.url}?{urllib.parse.urlencode(self.params(query, filter, cursor))}"
        attempt = 0
        while True:
            self.throttle()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lacuna/0.1"}), timeout=TIMEOUT_S) as r:
                    return FetchedPage(r.read().decode("utf-8", "replace"), _number(r.headers, "x-ratelimit-cost-usd"), _number(r.headers, "x-ratelimit-remaining-usd"))
            except urllib.error.HTTPError as e:
                status, headers, body = e.code, e.headers, e.read().decode("utf-8", "replace")
            except urllib.error.URLError as e:  # transport errors aren't repeated, and show no address
                raise ApiError(f"request failed: {sanitised(str(e.reason), self.api_key)}") from None
            again = status == 429 or status >= 500
            # What is left counts only where the request would be repeated; other errors keep their own text.
            if again and (left := _number(headers, "x-ratelimit-remaining-usd")) is not None and left < MIN_REMAINING_USD:
                raise BudgetExhausted(f"status {status}: {left} USD left")
            if not again or attempt >= MAX_RETRIES:
                raise ApiError(f"status {status}: {sanitised(body, self.api_key)}")
            delay = retry_delay(attempt, headers.get("Retry-After"))
            self.log(f"status {status}, again in {delay:.1f} s ({attempt + 1}/{MAX_RETRIES})")
            self.sleep(delay)
            attempt += 1


def page_body(text: str) -> dict:
    """A page: a JSON object that has ``results``, an array or null."""
    page = json.loads(text)
    if not isinstance(page, dict) or "results" not in page or not isinstance(page["results"], (list, type(None))):
        raise ValueError("not a page of works")
    return page


class WorksDataSource(DataSource):
    """``spark.read.format("works_api")``: raw pages of one or more queries; each query's cursor chain is a partition.

    Options: ``queries`` (one a line), ``filter``, ``limit`` (works with an id, of each query), ``url``, ``api_key``.
    A chain ends early, with the pages it has, where what is left to spend pays for no further request; one that has
    no page by then fails. Nothing is cached: a task that is run again asks again, so write the pages before using them.
    """

    @classmethod
    def name(cls):
        return "works_api"

    def schema(self):
        return "query string, page int, body string"

    def reader(self, schema):
        return WorksReader(dict(self.options))


@dataclass
class QueryPartition(InputPartition):
    query: str

    def __post_init__(self):
        super().__init__(self.query)


class WorksReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [QueryPartition(q) for q in self.options.get("queries", "").split("\n") if q.strip()]

    def read(self, partition):
        if partition is None:  # no queries
            return
        o = self.options
        client = HttpClient(o.get("api_key"), o.get("url", WORKS_URL))
        cursor, got, page, limit = "*", 0, 0, int(o.get("limit", 2000))
        while cursor is not None and got < limit:
            try:
                fetched = client.fetch_page(partition.query, o.get("filter"), cursor)
            except BudgetExhausted:
                if not page:
                    raise
                return
            body = page_body(fetched.body)
            if not body["results"]:
                return
            yield partition.query, page, fetched.body
            if fetched.remaining_usd is not None and fetched.remaining_usd < MIN_REMAINING_USD:
                return
            got, page, cursor = got + sum(r.get("id") is not None for r in body["results"]), page + 1, (body.get("meta") or {}).get("next_cursor")
