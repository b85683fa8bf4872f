"""Shared intermediate tables.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, a folder that
driver and executors share, so a lost executor costs no recomputation of the
stages before it.  Where the session has no such setting (tests on one
machine), a folder of our own is set once.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
#: Seconds for which Java objects that Python has dropped are waited for.
DETACH_S = 10.0


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = f"own:{sc.applicationId}"
    if key not in _written:
        _written[key] = ["file://" + tempfile.mkdtemp(prefix="threadloom-")]
    return _written[key][0]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``table`` that nothing will read again, and let go of shuffles that nothing refers to."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    ours = _written.get(spark.sparkContext.applicationId, [])
    files = df.inputFiles()
    for path in [p for p in ours if files and p.rsplit("/", 1)[-1] in files[0]]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        ours.remove(path)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Have shuffles deleted that nothing refers to."""
    gc.collect()
    # py4j drops Java objects in a thread of its own that looks once a second; Java's collector finds them held until then
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + DETACH_S
    while dropped and time.monotonic() < until:
        time.sleep(0.05)
    # the last one may be on its way; what a first collection leaves of the last plan goes with a second
    for _ in range(2):
        time.sleep(0.1)
        spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written.  Call it once their readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the input tables, with the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df

