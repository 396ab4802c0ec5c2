"""What registers queries: by a function, over literal columns, or over a literal table.

Modules of queries import this one and never the registry, so tasks that read
functions of theirs load no more than they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query under ``name`` with its oracle."""

    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def literal(x: object) -> str:
    """A Python value as DuckDB SQL."""
    if x is None or isinstance(x, bool):
        return {None: "NULL", True: "true", False: "false"}[x]
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"'{k}': {literal(v)}" for k, v in x.items()) + "}"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def cases(name: str, schema: str, rows: list, names: str, want: list, made: Callable[[Column, Column, Column], dict[str, Column]]) -> None:
    """A query over a few literal rows, numbered as ``i``, whose results, worked out by hand, are its oracle.

    ``made`` gives the result columns ``names`` from the columns x, y and z; ``want``
    has a tuple of their values, or the one value, for each row.
    """
    values = ", ".join("(" + ", ".join(map(literal, (i, *(w if isinstance(w, tuple) else (w,))))) + ")" for i, w in enumerate(want))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
        return df.select("i", *(c.alias(k) for k, c in made(F.col("x"), F.col("y"), F.col("z")).items()))

    QUERIES[name] = (run, f"SELECT * FROM (VALUES {values}) AS t(i, {', '.join(f'"{n}"' for n in names.split(', '))})")


def rows(name: str, schema: str, given: list[tuple], columns: str, want: list[tuple], make: Callable[[DataFrame], DataFrame]) -> None:
    """A query over a literal table, whose rows, worked out by hand, are its oracle."""
    values = ", ".join("(" + ", ".join(map(literal, w)) + ")" for w in want)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark.createDataFrame(given, schema)).select(*columns.split(", "))

    QUERIES[name] = (run, f"SELECT * FROM (VALUES {values}) AS t({', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns.split(', '))})")
