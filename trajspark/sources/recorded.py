"""HTTP sources over recorded responses: a Python data source that follows page tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Request(InputPartition):
    def __init__(self, url: str, query: str):
        self.url, self.query = url, query


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Path(options["path"])
        self.items, self.token = options.get("items", "items"), options.get("token", "nextPageToken")
        self.requests = [tuple(x) for x in json.loads(options["requests"])]
        self.pages = int(options.get("pages", "1000"))

    def partitions(self) -> list[_Request]:
        return [_Request(url, query) for url, query in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple]:
        """The items of all pages of one request, in order; pages end without a token, or where one comes again."""
        recorded = {}
        for file in sorted(self.folder.glob("*.jsonl")):
            with file.open(encoding="utf-8") as lines:
                for line in lines:
                    r = json.loads(line)
                    if r["url"] == partition.url and r.get("query", "") == partition.query:
                        recorded.setdefault(r.get("page_token") or "", r)
        at, seen, n = "", set(), 0
        while at not in seen and len(seen) < self.pages:
            seen.add(at)
            r = recorded.get(at)
            if r is None or r.get("status", 200) != 200:
                yield partition.url, partition.query, len(seen) - 1, None, None, f"no response recorded for page '{at}'" if r is None else f"status {r['status']}"
                return
            body = r["body"]
            for item in body.get(self.items, []):
                yield partition.url, partition.query, len(seen) - 1, n, json.dumps(item, ensure_ascii=False), None
                n += 1
            at = body.get(self.token) or ""
            if not at:
                return


class RecordedHttp(DataSource):
    """Format 'recorded_http'.  Options: path, a folder that all machines see, of .jsonl files of {url, query, page_token, status, body};
    requests, a JSON list of [url, query]; items and token, the fields of a body's items and of its next page.
    Each request is one partition.  A page that is not recorded gives a row with an error instead of items."""

    @classmethod
    def name(cls) -> str:
        return "recorded_http"

    def schema(self) -> str:
        return "url string, query string, page int, position int, item string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedHttp)
