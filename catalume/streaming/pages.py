"""Rows of a paged service as a stream: the offset is the page number, so that a restarted stream goes on with the page after the last one that it finished."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, FloatType, StructType

#: Pages that are looked up at once, tries of a page that can't be read, and seconds before the second try (doubled for each more).
PROBED, TRIES, PAUSE = 1000, 3, 0.5


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PageReader(DataSourceStreamReader):
    """One task a page. Pages are numbered from 1 and come in order: the first that is missing or empty ends what is there so far."""

    def __init__(self, schema: StructType, options: dict):
        self.wanted, self.path, self.pattern = schema, options["path"].rstrip("/"), options.get("pattern", "page_{page}.jsonl")
        self.tries, self.pause = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there, root = fs.FileSystem.from_uri(self.path)
        while True:
            numbers = range(self.last + 1, self.last + 1 + PROBED)
            found = there.get_file_info([f"{root}/{self.pattern.format(page=n)}" for n in numbers])
            for n, info in zip(numbers, found):
                if info.type == fs.FileType.NotFound or (info.type == fs.FileType.File and not info.size):
                    return {"page": self.last}
                self.last = n

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Page(n) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        there, root = fs.FileSystem.from_uri(self.path)
        for line in self._lines(there, f"{root}/{self.pattern.format(page=partition.number)}"):
            row = json.loads(line)
            yield tuple(float(v) if v is not None and isinstance(f.dataType, (DoubleType, FloatType)) else v for f in self.wanted.fields for v in (row.get(f.name),))

    def _lines(self, there: fs.FileSystem, path: str) -> list[bytes]:
        """The lines of a page, whole before any row is passed on, so that a page that fails is read again from its start."""
        for left in range(self.tries - 1, -1, -1):
            try:
                files = [path]
                if there.get_file_info(path).type == fs.FileType.Directory:
                    files = sorted(f.path for f in there.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith(("_", ".")))
                lines = []
                for f in files:
                    with there.open_input_stream(f) as s:
                        lines += s.read().splitlines()
                return [x for x in lines if x.strip()]
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause * 2 ** (self.tries - 1 - left))
        return []


class PagedSource(DataSource):
    """Format `pages`: JSON lines of the pages under ``path``, each a file or folder whose name is ``pattern`` with the number for `{page}`. A schema must be given; fields that a row lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(schema, dict(self.options))


def fetch_pages(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Appends the rows of all pages that are there and weren't fetched before to ``out`` (Parquet), each page once, however often the stream is stopped; ends when no page is left. A run after one that failed ends the pages that were begun; what is new comes with the next."""
    spark.dataSource.register(PagedSource)
    rows = spark.readStream.format("pages").schema(schema).options(**options).load(path)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
