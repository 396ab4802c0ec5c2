"""A paged listing as a Spark data source.

``fetch(start, size)`` returns (rows, total or None).  A listing ends where the
total is reached, a page is empty, or, only without a total, a page is short; it
goes on by as many rows as came, so a server that caps pages skips none.  One that
is cut off by its bound is an error unless part of it is asked for, as what is left
out would otherwise look deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CutOff(ValueError):
    """A listing has more rows than it was allowed to read."""


def pages(fetch: Callable[[int, int], tuple[list, int | None]], size: int, most: int, start: int = 0, end: int | None = None, partial: bool = False) -> Iterator[object]:
    """Rows of a listing from ``start`` up to ``end``, or up to ``most`` rows, beyond which it is cut off."""
    at, stop = start, min(start + most, end if end is not None else start + most)
    while at < stop:
        rows, total = fetch(at, min(size, stop - at))
        yield from rows[: stop - at]
        at += len(rows)
        if not rows or (total is not None and at >= total) or (total is None and len(rows) < min(size, stop - at + len(rows))):
            return
    if end is None and not partial and fetch(at, 1)[0]:
        raise CutOff(f"the listing has more than {most} rows")


class _Range(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.size, self.most, self.parts = options["fetch"], options["size"], options["most"], options["parts"]
        self.partial = options["partial"]

    def partitions(self) -> list[InputPartition]:
        total = self.fetch(0, 1)[1]
        if total is None or self.parts < 2:
            return [_Range(0, None)]
        if total > self.most and not self.partial:
            raise CutOff(f"the listing has {total} rows, more than {self.most}")
        step = max(self.size, -(-min(total, self.most) // self.parts))
        return [_Range(at, min(at + step, total, self.most)) for at in range(0, min(total, self.most), step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for row in pages(self.fetch, self.size, self.most, partition.start, partition.end, self.partial):
            yield (json.dumps(row, ensure_ascii=False),)


def listing(spark: SparkSession, name: str, fetch: Callable[[int, int], tuple[list, int | None]], size: int = 100, most: int = 100_000, parts: int = 8, partial: bool = False) -> DataFrame:
    """(row) with the JSON of each listed object; ranges of a listing with a total are read side by side."""
    options = {"fetch": fetch, "size": size, "most": most, "parts": parts, "partial": partial}

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "row string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(options)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()
