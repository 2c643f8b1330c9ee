"""Paged record services: a client protocol, an HTTP client, and tables of their JSON records.

A page is asked for by path, start, size and (for changes only) since, a version. Where the service tells the total, the
pages are dealt to the executors, one partition a page, so the driver holds no records; else the driver follows the
links from page to page and gathers them.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, InputPartition

from lexatlas.distribution import ship

#: Kind of record -> path below the library; {} stands for a key.
PATHS = {"collections": "/collections", "tags": "/tags", "items": "/items", "top_items": "/items/top", "collection_items": "/collections/{}/items", "children": "/items/{}/children"}
PAGE, TIMEOUT = 100, 2.0


class RecordError(RuntimeError):
    pass


@dataclass
class Page:
    """Records, the number that there are in all (null if not told), the next page's address (null at the end) and the library's version (null if not told)."""

    records: list[dict]
    total: int | None = None
    next: str | None = None
    version: int | None = None


class RecordClient(Protocol):
    """What a service must offer; it travels to the executors, so it holds no connections."""

    def page(self, path: str, start: int, size: int, since: int | None = None) -> Page: ...

    def follow(self, address: str) -> Page: ...


@dataclass
class HttpClient:
    base: str
    library: str = "/users/0"
    timeout: float = TIMEOUT

    def page(self, path: str, start: int, size: int, since: int | None = None) -> Page:
        asked = {"start": max(0, start), "limit": max(0, size)} | ({} if since is None else {"since": since})
        return self.follow(f"{self.base.rstrip('/')}{self.library}{path}?{urllib.parse.urlencode(asked)}")

    def follow(self, address: str) -> Page:
        try:
            with urllib.request.urlopen(address, timeout=self.timeout) as answer:
                found, headers = json.load(answer), answer.headers
        except (OSError, ValueError) as error:
            raise RecordError(f"{address}: {error}") from error
        if not isinstance(found, list):
            raise RecordError(f"{address}: no list of records")
        number = lambda name: int(x) if (x := headers.get(name, "")).isdigit() else None
        return Page([r for r in found if isinstance(r, dict)], number("Total-Results"), next_link(headers.get("Link", "")), number("Last-Modified-Version"))


def next_link(header: str) -> str | None:
    """The address that a Link header calls next."""
    for part in header.split(","):
        if found := re.search(r"<([^>]*)>\s*;.*\brel\s*=\s*\"?next\b", part):
            return found[1]
    return None


def count(client: RecordClient, kind: str, key: str = "") -> int | None:
    """How many records of a kind there are, by one page of one record."""
    return client.page(PATHS[kind].format(key), 0, 1).total


def fetch(spark: SparkSession, client: RecordClient, kind: str, key: str = "", limit: int | None = None, since: int | None = None, page_size: int = PAGE) -> DataFrame:
    """The records of a kind as rows of JSON text, up to a limit if there is one."""
    ship(spark)
    path = PATHS[kind].format(key)
    first = client.page(path, 0, page_size if limit is None else min(page_size, max(0, limit)), since)
    if first.total is None:
        return spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in _followed(client, first, limit)], "json string")
    wanted = first.total if limit is None else min(first.total, max(0, limit))
    starts = spark.range(0, wanted, page_size, max(1, -(-wanted // page_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                records = client.page(path, start, min(page_size, wanted - start), since).records
                yield pa.RecordBatch.from_pydict({"json": pa.array([json.dumps(r, sort_keys=True) for r in records[: wanted - start]], pa.string())})

    return starts.mapInArrow(run, "json string")


def _followed(client: RecordClient, page: Page, limit: int | None) -> Iterator[dict]:
    left = limit
    while True:
        for r in page.records:
            if left is not None and left <= 0:
                return
            yield r
            left = None if left is None else left - 1
        if page.next is None or left == 0:
            return
        page = client.follow(page.next)


class RecordSource(DataSource):
    """The data source "records": rows (version, json) of a kind of records of a service, batch and stream.

    Options: base, library, kind, key, since (only records of later versions), page_size. A partition is a page, so records go
    straight to the executors. A filter on version is asked of the service. As a stream its offset is a version: a batch holds
    the records of later versions up to the next one, and is the same when it is read again.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "version long, json string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


@dataclass
class _Pages(InputPartition):
    start: int
    since: int | None
    upto: int | None = None


class _Reads:
    def __init__(self, options):
        self.client = HttpClient(options["base"], options.get("library", "/users/0"), float(options.get("timeout", TIMEOUT)))
        self.path = PATHS[options.get("kind", "items")].format(options.get("key", ""))
        self.size, self.since = int(options.get("page_size", PAGE)), int(options["since"]) if "since" in options else None

    def pages(self, since: int | None, upto: int | None = None) -> list[_Pages]:
        total = self.client.page(self.path, 0, 1, since).total
        if total is None:
            raise RecordError("the service tells no total")
        return [_Pages(start, since, upto) for start in range(0, total, self.size)]

    def read(self, partition: _Pages):
        for r in self.client.page(self.path, partition.start, self.size, partition.since).records:
            version = int(r.get("version") or 0)
            if (partition.since is None or version > partition.since) and (partition.upto is None or version <= partition.upto):
                yield version, json.dumps(r, sort_keys=True)


class _Reader(_Reads, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("version",) and isinstance(f.value, int):
                self.since = f.value if self.since is None else max(self.since, f.value)
            else:
                yield f

    def partitions(self):
        return self.pages(self.since)


class _StreamReader(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"version": self.since or 0}

    def latestOffset(self) -> dict:
        version = self.client.page(self.path, 0, 1).version
        if version is None:
            raise RecordError("the service tells no version")
        return {"version": version}

    def partitions(self, start: dict, end: dict):
        return self.pages(start["version"], end["version"]) if end["version"] > start["version"] else []


def register(spark: SparkSession) -> None:
    """Make spark.read.format("records") and spark.readStream.format("records") known."""
    ship(spark)
    spark.dataSource.register(RecordSource)
