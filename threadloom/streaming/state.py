"""The keyed folds as stateful streaming operators.

A fold's step runs unchanged: its state is one value per key, kept in the
state store between micro-batches.  Rows of one micro-batch are put in order
before they are folded; a batch replay over the same rows gives the same
output.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ..plans.fold import Step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    def __init__(self, order: list[str], init: Callable[[Any], Any], step: Step, columns: list[str]):
        self.order, self.make, self.step, self.columns = order, init, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        state = pickle.loads(bytes(held[0])) if held else self.make(key[0])
        out: list[tuple] = []
        batch = sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: tuple(r[c] for c in self.order))
        for r in batch:
            out += self.step(state, {k: v.tolist() if hasattr(v, "tolist") else v for k, v in r.items()})
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def streaming_fold(df: DataFrame, key: str, order: list[str], init: Callable[[Any], Any], step: Step, schema: str) -> DataFrame:
    """A fold over a stream; the session must use a state store that holds several column families (``STORE``)."""
    kind = _parse_datatype_string(schema)
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=_Fold(order, init, step, kind.names), outputStructType=kind, outputMode="Append", timeMode="None")
