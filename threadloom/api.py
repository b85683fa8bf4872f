"""Three calls over the whole: write turns, ask for contexts, shut down.

Turns are rows of turn, source, room_id, user_id, nickname, user_input,
assistant_text, event_ts and vec, as ``sources.fixtures.turns`` makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import DEFAULT, Guard
from .operators.guard import admissions, credits, gates
from .operators.ingest import committed, merged, settled_events
from .operators.retrieval import Store, assemble
from .operators.router import route
from .sources.durability import Saver, Snapshots


class Memory:
    """A store under one folder; what is written is versioned there."""

    def __init__(self, spark: SparkSession, folder: str, guard: Guard = DEFAULT.guard):
        self.spark, self.guard = spark, guard
        self.saver = Saver(Snapshots(spark, folder))

    def ingest(self, turns: DataFrame) -> DataFrame:
        """The memories that admitted turns write; they are saved by the next flush."""
        c = credits(admissions(turns), self.guard)
        t = turns.join(gates(c, self.guard).where("write").select("turn"), "turn", "left_semi")
        written = merged(committed(settled_events(t, route(t))))
        self.saver.mark("memories", written)
        self.saver.mark("actors", c.groupBy("actor_key").agg({"turn": "max"}).withColumnRenamed("max(turn)", "last"))
        return written

    def compile(self, store: Store, turns: DataFrame) -> DataFrame:
        """The context blocks of the store's queries, which are among the turns."""
        return assemble(store, turns, self.guard)

    def shutdown(self) -> list[str]:
        """Writes what is not written yet; the names of it."""
        return self.saver.flush()
