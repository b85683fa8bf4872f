"""Event-time aggregation of a message stream with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.fixtures import read


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, user_id, n, total of each hour; ``ts`` without zone is read as UTC."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    by = e.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "user_id", "n", "total")


@query("w1_hourly_activity", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, user_id, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch run of the streaming aggregation."""
    a = activity(read(spark, sf_dir, "events"))
    return a.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "user_id", "n", F.round("total", 4).alias("total"))
