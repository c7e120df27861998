"""Folds over ordered streams: what a row gets depends on all rows of its key before it.

Spark brings the rows of a key into one task in order (an external sort, which spills);
Python sees them in Arrow batches and holds the state of one key, never a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], schema: StructType) -> DataFrame:
    """One row of ``schema`` for each row: ``step`` gets the state of the row's key, which
    ``start`` makes and ``step`` changes, and the row.  Null keys are one key."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row[key] != now:
                    state, now = start(), row[key]
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
