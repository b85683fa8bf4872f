"""Batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.config import DEFAULT
from threadloom.operators.guard import CREDIT_SCHEMA, Credit, admissions, credit_step, credits
from threadloom.sources.fixtures import read, turns
from threadloom.streaming.state import streaming_fold
from threadloom.streaming.windows import activity


def test_credit_stream_equals_batch(spark, data, tmp_path):
    adm = admissions(turns(spark, data)).select("actor_key", "turn", "source", "ts", "risk")
    for k in range(2):  # two files, hence two micro-batches
        adm.where((F.col("turn") > 40) == (k == 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(adm.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = streaming_fold(stream, "actor_key", ["turn"], Credit, credit_step(DEFAULT.guard), CREDIT_SCHEMA)
    q = out.writeStream.format("memory").queryName("credit_rows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(map(tuple, spark.table("credit_rows").select("actor_key", "turn").collect()))
    assert got == sorted(map(tuple, credits(adm).select("actor_key", "turn").collect()))


def test_hourly_activity_with_watermark(spark, data, tmp_path):
    e = read(spark, data, "events").select("ts", "user_id", "value")
    e.write.parquet(f"{tmp_path}/ev")
    s = activity(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ev"))
    q = s.writeStream.format("memory").queryName("activity_rows").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.table("activity_rows").agg(F.sum("n")).first()[0] == activity(e).agg(F.sum("n")).first()[0]
