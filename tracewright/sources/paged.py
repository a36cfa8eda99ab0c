"""A Python data source for paged JSON APIs: every start URL is a partition that follows its own next links."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NEXT = re.compile(r'<([^>]+)>;\s*rel="next"')


@dataclass
class StartPage(InputPartition):
    url: str


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.tries, self.wait, self.timeout = int(options.get("tries", 5)), float(options.get("wait", 1)), float(options.get("timeout", 15))
        self.token = options.get("token")

    def partitions(self) -> list[StartPage]:
        return [StartPage(u) for u in self.urls]

    def fetch(self, url: str) -> tuple[list, str | None]:
        """Rows and next link of a page; refusals are tried again after 1, 2, 4, ... waits, then give no rows."""
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as page:
                    found = json.load(page)
                    link = _NEXT.search(page.headers.get("Link") or "")
                    return found if isinstance(found, list) else [found], link[1] if link else None
            except urllib.error.HTTPError as e:
                if e.code not in (403, 429):
                    raise
                time.sleep(self.wait * 2**attempt)
        return [], None

    def read(self, partition: StartPage) -> Iterator[tuple]:
        url, seq = partition.url, 0
        while url:
            rows, url = self.fetch(url)
            for row in rows:
                yield partition.url, seq, json.dumps(row)
                seq += 1


class PagedSource(DataSource):
    """Rows (start, seq, json); `urls` are start URLs parted by spaces; also tries, wait, timeout, token."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start string, seq long, json string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
