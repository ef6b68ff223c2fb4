"""Folds over ordered rows in bounded memory.

Rows of a key go to one partition, are sorted there (Spark spills the sort) and pass
through a generator batch by batch, so a stream of any length costs the state of its
fold and no more.  Order makes a fold sequential within a key; many keys run beside
one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a fold gives back.
BATCH = 8192


def ordered(rows: DataFrame, order: list[str | Column], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, key: str = "stream_id") -> DataFrame:
    """``fold`` over the rows of each key in order, as tuples of the columns of ``rows``.

    ``key`` has to be the first column.  The fold yields tuples of ``schema``, none or
    many for a row; rows whose key is null are a key of their own.
    """
    if rows.columns[0] != key:
        raise ValueError(f"{key} has to be the first column")
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        results = (out for _, group in groupby(flat, itemgetter(0)) for out in fold(group))
        while part := list(islice(results, BATCH)):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*part, strict=True), made.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=made)

    by = [F.col(c) if isinstance(c, str) else c for c in order]
    return rows.repartition(key).sortWithinPartitions(F.col(key), *by).mapInArrow(run, schema)
