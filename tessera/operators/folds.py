"""Folds: rules that depend on what was kept before, over the rows of a key in order.

Partitions are sorted by key and order, and read as Arrow batches, so a fold holds its state and what it
hasn't handed on yet, not a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed on at a time.
ROWS = 4096


class Fold(Protocol):
    def add(self, row: tuple) -> list[tuple]:
        """What is settled once this row has come."""

    def end(self) -> list[tuple]:
        """What is settled once no more rows come."""


def folded(rows: DataFrame, key: str, order: list[str], begin: Callable[[object], Fold], schema: str) -> DataFrame:
    """What begin(key) makes of the rows of each key, which come as tuples of all columns, in order."""
    at = rows.columns.index(key)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((),) * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: Fold | None = None
        now, out = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or row[at] != now:
                    if fold is not None:
                        out += fold.end()
                    now, fold = row[at], begin(row[at])
                out += fold.add(row)
                if len(out) >= ROWS:
                    yield batch_of(out)
                    out = []
        if fold is not None:
            out += fold.end()
        yield batch_of(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
