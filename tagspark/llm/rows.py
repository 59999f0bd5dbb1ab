"""What the operators of this package share: columns by exact name, and Arrow batches as Python values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name: other columns may be named like them in another case, or hold dots."""
    columns = df.columns
    numbered = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return numbered.select(*[F.col(f"_{columns.index(name)}").alias(name) for name in names])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; none for a null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most_bytes` in each; a single longer value stays whole."""
    for batch in batches:
        values = batch.column(column)
        start = size = 0
        for i in range(batch.num_rows):
            here = len(values[i].as_buffer()) if values[i].is_valid else 0
            if i > start and size + here > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += here
        if batch.num_rows > start:
            yield batch.slice(start)


class Bounded(dict):
    """A memo of what `make` returns, of at most `limit` entries. Keys over `longest` are not kept.

    Entries live in two generations: when the younger one is half the limit, it becomes the older and that one goes,
    so what is asked for again and again stays.
    """

    def __init__(self, make, limit: int = 1 << 20, longest: int = 64):
        super().__init__()
        self.make, self.half, self.longest, self.older = make, limit // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value
