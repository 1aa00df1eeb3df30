"""Paged web APIs as Spark data sources: ``spark.read.format("paged_api")``, and
``spark.readStream`` for scans that go on where they stopped.

Options: ``url`` (a base that answers with JSON), ``style`` (``offset``, or ``keyset`` where a page
starts after the last id), ``page_size``, ``max_pages``, ``throttle`` (seconds between pages of the
whole scan), ``items`` (field that holds the list, if the answer is an object), ``until_short`` (a
page shorter than asked ends the scan) or ``next`` (the scan ends without this field), ``params``
(further ones, JSON), ``token_env`` (name of the variable that holds a token), ``attempts`` and
``patience`` (tries of a page, and the most seconds between two), ``timeout``, ``cache`` (folder of
raw pages, by address, which must be shared by all tasks), ``partitions`` and, for streams,
``batch_pages`` (pages of a batch; with a cache, of the first one).

Rows are the items' JSON. Pages of the ``keyset`` style depend on each other, so a scan of them is
one partition. Those of the ``offset`` style do not: ``partitions`` tasks take every so many-th
page each, until one is the last. Their pauses are as many times longer, so that the server
sees the same rate from all of them.

A stream's offset is the place of the next page. Spark commits it after a batch's rows are
written, so a scan that was stopped asks for no page of a finished batch again, and repeats the
pages of an unfinished one, from the cache if there is one.
"""

from __future__ import annotations

import email.utils
import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from augur.sources.shared import shared_dir
from augur.sources.shared_files import read_bytes, write_bytes

#: Page sizes and pauses that the platforms allow.
PRESETS = {
    "metaculus": {"style": "offset", "page_size": "100", "throttle": "0.25", "items": "results", "next": "next", "params": '{"statuses": "resolved", "forecast_type": "binary"}'},
    "polymarket": {"style": "offset", "page_size": "500", "throttle": "0.2", "items": "markets", "until_short": "true", "params": '{"closed": "true", "active": "false"}'},
    "manifold": {"style": "keyset", "page_size": "1000", "throttle": "0.2", "until_short": "true"},
}
AGENT = "Mozilla/5.0 (compatible; question-reader)"


class PermissionRefused(PermissionError):
    pass


class Throttled(Exception):
    """A refusal that may pass: 429, 5xx, or no connection; with the pause asked for, if any."""

    def __init__(self, text: str, pause: float | None = None):
        super().__init__(text)
        self.pause = pause


def _fetch(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body of an address, by the requests library where it is installed."""
    try:
        import requests
    except ImportError:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, b""
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Throttled(f"{url}: {e}") from e
    try:
        answer = requests.get(url, headers=headers, timeout=timeout)
    except (requests.ConnectionError, requests.Timeout) as e:
        raise Throttled(f"{url}: {e}") from e
    return answer.status_code, {k.lower(): v for k, v in answer.headers.items()}, answer.content


def retry_after(value: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds that a Retry-After header asks for, given as a number or as a date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        try:
            return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now())
        except ValueError:
            return None


def http_get_json(url: str, token: str | None = None, timeout: float = 30.0) -> object:
    """JSON of an address; 401 and 403 say that a token is missing or wrong."""
    headers = {"User-Agent": AGENT, "Accept": "application/json", **({"Authorization": f"Token {token}"} if token else {})}
    status, answered, body = _fetch(url, headers, timeout)
    if status in (401, 403):
        raise PermissionRefused(f"{url} asks for a token ({status})")
    if status == 429 or status >= 500:
        raise Throttled(f"{url} answered {status}", retry_after(answered.get("retry-after")))
    if status >= 400:
        raise ValueError(f"{url} answered {status}")
    return json.loads(body)


def patiently(get: Callable[[], object], attempts: int, patience: float, sleep: Callable[[float], None]) -> object:
    """What ``get`` gives, tried again after refusals that may pass: after the pause that
    was asked for, else after one that doubles, with jitter, of at most ``patience`` seconds."""
    for i in range(attempts):
        try:
            return get()
        except Throttled as e:
            if i + 1 == attempts:
                raise
            sleep(min(patience, 2.0**i) * random.uniform(0.5, 1.0) if e.pause is None else e.pause)
    raise ValueError("at least one attempt is needed")


@dataclass(frozen=True)
class Page:
    """Items of a page, and the place of the next one, if the scan has not ended."""

    items: list[dict]
    next: dict | None


#: Where a scan begins. ``after`` is the last id of the keyset style.
START = {"page": 0, "offset": 0, "after": ""}


class Scan:
    """One scan of an API, page by page; a place says all that a page depends on."""

    def __init__(self, options: dict[str, str], get=http_get_json, sleep=time.sleep):
        self.o = {**PRESETS.get(options.get("preset", ""), {}), **options}
        self.get, self.sleep = get, sleep
        self.size, self.most = int(self.o.get("page_size", 100)), int(self.o.get("max_pages", 0))
        self.params = json.loads(self.o.get("params", "{}"))
        self.keyset = self.o.get("style", "offset") == "keyset"
        self.throttle = float(self.o.get("throttle", 0))

    def address(self, place: dict) -> str:
        at = {**self.params, "limit": self.size}
        if not self.keyset:
            at["offset"] = place["offset"]
        elif place["after"] != "":
            at["before"] = place["after"]
        return self.o["url"] + "?" + urllib.parse.urlencode(at)

    def body(self, url: str) -> object:
        """A page from the cache, else from the server."""
        name = page_file(self.o["cache"], url) if self.o.get("cache") else None
        known = read_bytes(name) if name else None
        if known is not None:
            try:
                return json.loads(known)
            except ValueError:  # an old page that was cut off
                pass
        token = os.environ.get(self.o.get("token_env", ""), "") or None
        args = (token, float(self.o["timeout"])) if "timeout" in self.o else (token,)
        got = patiently(lambda: self.get(url, *args), int(self.o.get("attempts", 6)), float(self.o.get("patience", 60)), self.sleep)
        if name:
            write_bytes(name, json.dumps(got).encode())
        return got

    def page(self, place: dict) -> Page:
        if self.most and place["page"] >= self.most:
            return Page([], None)
        body = self.body(self.address(place))
        items = body if isinstance(body, list) else body.get(self.o.get("items", "results"), [])
        last = items[-1].get("id") if items else None
        ended = not items or (self.o.get("until_short") == "true" and len(items) < self.size) or ("next" in self.o and isinstance(body, dict) and not body.get(self.o["next"]))
        if ended or (self.keyset and last is None) or (self.most and place["page"] + 1 >= self.most):
            return Page(items, None)
        return Page(items, {"page": place["page"] + 1, "offset": place["offset"] + len(items), "after": "" if last is None else last})

    def pages(self, place: dict | None = None) -> Iterator[list[dict]]:
        """Items page by page, from a place on."""
        place = place or START
        while True:
            page = self.page(place)
            if page.items:
                yield page.items
            if page.next is None:
                return
            place = page.next
            self.sleep(self.throttle)

    def share(self, i: int, n: int) -> Iterator[list[dict]]:
        """Items of the pages i, i + n, ... of the offset style, with n times longer pauses."""
        at = i
        while True:
            page = self.page({"page": at, "offset": at * self.size, "after": ""})
            if page.next is not None and len(page.items) != self.size:
                raise ValueError(f"the server gives {len(page.items)} items a page in place of {self.size}; scan it with one partition")
            if page.items:
                yield page.items
            if page.next is None:
                return
            at += n
            self.sleep(self.throttle * n)


def pages(options: dict[str, str], get=http_get_json, sleep=time.sleep) -> Iterator[list[dict]]:
    """Items page by page."""
    yield from Scan(options, get, sleep).pages()


def page_file(folder: str, url: str) -> str:
    """Where a page is kept; the key is the whole address."""
    return f"{folder.rstrip('/')}/{hashlib.sha256(url.encode()).hexdigest()}.json"


def store_pages(found: DataFrame, folder: str) -> int:
    """Puts pages (url, body) that were got elsewhere into a cache, each task its own, and counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, body in zip(*(c.to_pylist() for c in batch.columns)):
                write_bytes(page_file(folder, url), body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return found.select("url", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _lines(items: list[dict]) -> Iterator[tuple[str]]:
    for item in items:
        yield (json.dumps(item, ensure_ascii=False),)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 1))
        return [InputPartition(i) for i in range(1 if Scan(self.options).keyset else n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scan, n = Scan(self.options), len(self.partitions())
        for items in scan.pages() if n == 1 else scan.share(partition.value, n):
            yield from _lines(items)


#: Bytes of items behind which a batch of more than ``batch_pages`` pages ends.
BATCH_BYTES = 4 << 20


class PagedStream(SimpleDataSourceStreamReader):
    """Reads ``batch_pages`` pages at a time. At the end of a scan the place stays, so later
    polls ask for its page again and find what the server has added behind it.

    With a cache a batch that fails costs no request, as its pages stay there. Then batches
    become twice as long, one after another, until the scan ends or they hold BATCH_BYTES, so that the
    work of a commit does not come with every few pages of a long scan."""

    def __init__(self, options: dict[str, str]):
        self.scan, self.least = Scan(options), int(options.get("batch_pages", 10))
        self.most = self.least

    def initialOffset(self) -> dict:
        return dict(START)

    def _batch(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        rows: list[tuple] = []
        place, size, ended = start, 0, False
        for i in range(self.most if end is None else 1 << 30):
            if place == end or (end is None and i >= self.least and size >= BATCH_BYTES):
                break
            if i:
                self.scan.sleep(self.scan.throttle)
            page = self.scan.page(place)
            lines = list(_lines(page.items))
            rows += lines
            size += sum(len(x) for x, in lines)
            ended = page.next is None
            if not ended:
                place = page.next
            elif not page.items or (self.scan.most and place["page"] >= self.scan.most):
                break
            else:
                # The last page was read; what follows it stands behind its items.
                last = page.items[-1].get("id")
                place = {"page": place["page"] + 1, "offset": place["offset"] + len(page.items), "after": "" if last is None else last}
                break
        if end is None and self.scan.o.get("cache"):
            self.most = self.least if ended else self.most if size >= BATCH_BYTES else 2 * self.most
        return rows, place

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, place = self._batch(start, None)
        return iter(rows), place

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._batch(start, end)[0])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def scan(spark: SparkSession, cache: str | None = None, **options: object) -> DataFrame:
    """Items of an API as JSON (column ``value``). ``cache``: a folder of pages; ``shared`` is one in
    the folder that driver and executors share."""
    register(spark)
    where = f"{shared_dir(spark).rstrip('/')}/pages" if cache == "shared" else cache
    return spark.read.format("paged_api").options(**{k: str(v) for k, v in options.items()}, **({"cache": where} if where else {})).load()


def scan_into(spark: SparkSession, path: str, checkpoint: str, cache: str | None = None, **options: object) -> int:
    """Appends the items of an API to line JSON under ``path`` as a stream, from its last
    committed page to the end, and gives the number of batches. A run that was stopped is
    continued by calling this again."""
    register(spark)
    where = f"{shared_dir(spark).rstrip('/')}/pages" if cache == "shared" else cache
    rows = spark.readStream.format("paged_api").options(**{k: str(v) for k, v in options.items()}, **({"cache": where} if where else {})).load()
    query = rows.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return int(query.lastProgress["batchId"]) + 1 if query.lastProgress else 0
    finally:
        query.stop()
