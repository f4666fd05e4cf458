"""A folder of fetched pages as a source, in batch and as a stream that resumes where it stopped.

A fetcher that pages through a history, forwards or backwards, leaves one JSON file a page,
named so that later pages sort after earlier ones; a page is an object with a list of rows.
The stream's offset is the name of the last page taken, so a restart from the checkpoint
reads each page once, and pages may be added while it runs.  The folder must be reachable
from every executor by the same path.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page string, place int, row string"


class Page(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.folder, self.field = options["path"].removeprefix("file://"), options.get("rows", "data")

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".json"))

    def read(self, partition: Page) -> Iterator[tuple[str, int, str]]:
        with open(os.path.join(self.folder, partition.name), encoding="utf-8") as f:
            rows = json.load(f).get(self.field) or []
        for place, row in enumerate(rows):
            yield partition.name, place, json.dumps(row)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> Sequence[Page]:
        return [Page(n) for n in self.names()]


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are page names; as many pages a batch as are there, or ``pagesPerBatch``."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.most = int(options.get("pagesPerBatch", "0"))
        self.told = ""

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        new = [n for n in self.names() if n > self.told]
        if new:
            self.told = new[min(self.most or len(new), len(new)) - 1]
        return {"page": self.told}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        self.told = max(self.told, end["page"])  # after a restart the first batch may be a replay
        return [Page(n) for n in self.names() if start["page"] < n <= end["page"]]


class PageSource(DataSource):
    """``spark.dataSource.register(PageSource)``, then format ``pages`` with ``path`` and the field of the ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)
