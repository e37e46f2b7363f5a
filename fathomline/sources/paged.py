"""A paged source as a Spark data source: every page is a partition, so pages are read in parallel.

``PagedSource`` reads pages stored as ``page-<n>.json`` (a list of records) in
a folder, the stand-in for a paged service. Its stream reads new pages from the
last one on, so a checkpoint holds the cursor.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    InputPartition,
    SimpleDataSourceStreamReader,
)
from pyspark.sql.types import StructType

_PAGE = re.compile(r"page-(\d+)\.json$")


def _pages(path: str) -> list[int]:
    return sorted(int(m[1]) for name in os.listdir(path) if (m := _PAGE.match(name)))


def _records(path: str, page: int, names: list[str]) -> Iterator[tuple]:
    with open(os.path.join(path, f"page-{page}.json"), encoding="utf-8") as file:
        for record in json.load(file):
            yield tuple(record.get(n) for n in names)


class PagedSource(DataSource):
    """``spark.read.format("pages").schema(...).load(folder)`` after ``spark.dataSource.register(PagedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options["path"], schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options["path"], schema, int(self.options.get("pages", "10")))


class PagedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.equal = path, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on whole columns are applied while pages are read; Spark applies all others."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _pages(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = [(self.names.index(n), v) for n, v in self.equal]
        for row in _records(self.path, partition.value, self.names):
            if all(row[i] == v for i, v in at):
                yield row


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.names, self.most = path, schema.names, most

    def initialOffset(self) -> dict:
        return {"page": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = [p for p in _pages(self.path) if p > start["page"]][: self.most]
        rows = [r for p in new for r in _records(self.path, p, self.names)]
        return iter(rows), {"page": new[-1] if new else start["page"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for p in _pages(self.path) if start["page"] < p <= end["page"] for r in _records(self.path, p, self.names)])

    def commit(self, end: dict) -> None:
        pass
