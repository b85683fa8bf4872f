"""Ordered folds over keyed rows, with memory for one state at a time.

Rows are dealt by key and sorted inside the partition, and one pass carries
the state of the current key from row to row, whatever batches Arrow cuts.
The step function is plain Python and is the one that the streaming wrapper
(``streaming.state``) runs too, so both give the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[Any, dict], list[tuple]]


def keyed_fold(df: DataFrame, key: str, order: list[str], init: Callable[[Any], Any], step: Step, schema: str, finish: Callable[[Any], list[tuple]] | None = None, tasks: int | None = None) -> DataFrame:
    """The rows that ``step(state, row)`` returns, states made by ``init(key)``; ``finish`` drains a state at its end; ``tasks`` are for few keys, which would meet in fewer."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun, out = None, None, False, []
        for b in batches:
            for row in b.to_pylist():
                if not begun or row[key] != current:
                    if begun and finish:
                        out += finish(state)
                    current, begun, state = row[key], True, init(row[key])
                out += step(state, row)
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
        if begun and finish:
            out += finish(state)
        yield batch(out)

    return (df.repartition(tasks, key) if tasks else df.repartition(key)).sortWithinPartitions(key, *order).mapInArrow(run, kind)
