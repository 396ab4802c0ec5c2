"""Texts in Python workers, held a small part of an Arrow batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def slices(batch: pa.RecordBatch, columns: list[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text columns, each of a row at least."""
    size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def mapped(source: DataFrame, texts: list[str], ddl: str, make: Callable[[pa.RecordBatch], list[dict] | pa.RecordBatch], most: int = 1 << 20) -> DataFrame:
    """What ``make`` gives, as columns of ``ddl``, for parts of about ``most`` bytes of text columns.

    Results are as small as what they come from, and after a task free memory goes back to the system.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, texts, most):
                found = make(part)
                yield pa.RecordBatch.from_pylist(found, schema=schema) if isinstance(found, list) else found
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return source.mapInArrow(run, ddl)
