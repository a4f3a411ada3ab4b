"""An incremental pull of landed pages of an API: a stream whose offset is the last moment that it has seen.

A page is a JSON file ``<moment>.json`` (the moment its rows go up to, as digits in order of time, say 20240120T123456) that holds an
array of objects. Each batch reads the pages after the last one's moment; a file is a partition, read by the executor it is given to
through Arrow's file systems, so the folder may be on any store these know. A batch that is planned again reads the same files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PAGE = re.compile(r"(?:.*/)?([0-9][0-9TZ]*)\.json$")
ROW = "external_id string, created_at string, source string, url string, title string, page string"


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pages(path: str) -> list[tuple[str, str]]:
    """(moment, file) of all pages in a folder, in order."""
    from pyarrow import fs

    store, folder = opened(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((m[1], f.path) for f in found if f.is_file and (m := PAGE.match(f.path)))


class Page(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)


class Reading:
    """What batch and stream share: the rows of a page."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # there are no pages
            return
        store, _ = opened(self.path)
        with store.open_input_stream(partition.value) as f:
            rows = json.loads(f.read().decode("utf-8", "replace") or "[]")
        page = PAGE.match(partition.value)[1]
        for row in rows if isinstance(rows, list) else []:
            if isinstance(row, dict):
                told = {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in row.items()} | {"page": page}
                yield tuple(told.get(n) for n in self.names)


class Whole(Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [Page(file) for _, file in pages(self.path)]


class Pull(Reading, DataSourceStreamReader):
    def __init__(self, path: str, names: list[str], after: str):
        super().__init__(path, names)
        self.after = after

    def initialOffset(self) -> dict:
        return {"after": self.after}

    def latestOffset(self) -> dict:
        found = pages(self.path)
        return {"after": max(found[-1][0], self.after) if found else self.after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(file) for moment, file in pages(self.path) if start["after"] < moment <= end["after"]]

    def commit(self, end: dict) -> None:
        """Files stay; the checkpoint keeps the offset."""


class LandedPages(DataSource):
    """Options: path, and after (a moment; pages up to it are passed over by a stream that begins)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return Whole(self.options["path"], schema.fieldNames())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Pull(self.options["path"], schema.fieldNames(), self.options.get("after", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
