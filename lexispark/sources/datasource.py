"""The paged services as a registered Spark data source: spark.read.format("lexispark_pages").options(...).load().

Options: fetch (module:function of query, offset, size, importable where tasks run), query, service, total, limit. A page is a partition.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import DOCUMENT_DDL, DOCUMENT_FIELDS
from .connectors import MAX_PAGES, PAGE_SIZES


class Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.fetch, self.query = options["fetch"], options.get("query", "")
        self.page = PAGE_SIZES.get(options.get("service", ""), 100)
        total = int(options.get("total", "10000"))
        self.wanted = min(total, int(options["limit"])) if "limit" in options else total
        self.pages = min(-(-self.wanted // self.page), MAX_PAGES.get(options.get("service", ""), 1 << 30))

    def partitions(self) -> list[Page]:
        return [Page(p * self.page, min(self.page, self.wanted - p * self.page)) for p in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        for record in getattr(importlib.import_module(module), name)(self.query, partition.offset, partition.size):
            yield tuple(record.get(n) for n in DOCUMENT_FIELDS)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexispark_pages"

    def schema(self) -> str:
        return DOCUMENT_DDL

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)


def sample_fetch(query: str, offset: int, size: int) -> list[dict]:
    """A stand-in for a service: 450 numbered records for any query."""
    return [{"title": f"{query} {i}", "publication_year": 2000 + i % 20, "bdd": "sample"} for i in range(offset, min(offset + size, 450))]
