"""Groups of a table in Python without a call for each: small groups would cost more by the call than by their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Output goes on by about so many rows or bytes, at a group's end.
OUT_ROWS, OUT_BYTES = 10_000, 4 << 20


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, type=f.type) for values, f in zip(zip(*rows), schema)], schema=schema)


def by_group(df: DataFrame, key: str, order: str, run: Callable[[object, list[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """run(key, rows) gives a group's output rows; rows: the table's columns in their order, sorted by `order`. Null is a
    key too, and an order that comes last.

    A group's rows are together in one task, and one group's rows are held there at a time besides an Arrow batch.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    at = df.columns.index(key)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out, size = [], 0
        for name, own in groupby(rows, lambda row: row[at]):
            made = list(run(name, list(own)))
            out += made
            size += sum(len(v) for row in made for v in row if isinstance(v, (bytes, str)))
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield _batch(out, arrow)
                out, size = [], 0
        if out:
            yield _batch(out, arrow)

    return df.repartition(key).sortWithinPartitions(F.col(key), F.col(order).asc_nulls_last()).mapInArrow(each, schema)
