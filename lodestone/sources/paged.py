"""A paged REST resource as a Spark data source: one partition a range of pages, read by the executors.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", "https://host/api/assay.json?type=B").option("items", "assays").load()

The resource takes `limit` and `offset` and answers with an array of items and their total number (`total`, a dotted path).
The driver asks for the number once and cuts the offsets into ranges; a task asks for its pages, trying each again with
growing pauses. Items stay JSON text, which `documents` parses by a pinned schema. A page that is short before the end,
or a total that a page contradicts, fails the task, so a changing resource gives an error rather than holes.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.sinks import commit, committed


@dataclass
class Pages(InputPartition):
    """Offsets low to high - 1 of a resource with `total` items."""

    low: int
    high: int
    total: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        # Options come by lower case.
        self.url, self.items, self.total = options["url"], options["items"], options.get("total", "page_meta.total_count")
        self.page, self.pages = int(options.get("pagesize", 1000)), int(options.get("pagesperpartition", 10))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 0.5))

    def _fetch(self, offset: int, limit: int) -> dict:
        url = f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode({'limit': limit, 'offset': offset})}"
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or attempt + 1 == self.tries:
                    raise
            except (OSError, ValueError):
                if attempt + 1 == self.tries:
                    raise
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def _count(self, page: dict) -> int:
        for part in self.total.split("."):
            page = page[part]
        return int(page)

    def partitions(self) -> list[Pages]:
        total, step = self._count(self._fetch(0, 1)), self.page * self.pages
        return [Pages(i, min(total, i + step), total) for i in range(0, total, step)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for low in range(partition.low, partition.high, self.page):
            want = min(self.page, partition.high - low)
            page = self._fetch(low, want)
            items = page[self.items]
            if len(items) != want or self._count(page) != partition.total:
                raise ValueError(f"the resource changed: {len(items)} items of {want} at {low}, {self._count(page)} in all, {partition.total} before")
            for k, item in enumerate(items):
                yield low + k, json.dumps(item)


class PagedJson(DataSource):
    """Rows offset, item (JSON) of a paged resource. Options: url, items, total, pageSize, pagesPerPartition, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "offset bigint, item string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))


def paged(spark: SparkSession, url: str, items: str, cache: str | None = None, refresh: bool = False, **options) -> DataFrame:
    """offset, item of a resource. With a cache (a folder that all machines share) it is fetched once and kept whole."""
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").options(url=url, items=items, **options).load()
    if cache is None:
        return rows
    if refresh or not committed(spark, cache):
        commit(rows, cache, replace=refresh)
    return spark.read.parquet(cache)


def documents(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of the items by a pinned schema, in the resource's order where it matters by `offset`."""
    return rows.select("offset", F.from_json("item", schema).alias("d")).select("offset", "d.*")
