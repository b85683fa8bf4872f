"""Derived tables that are written once and read by every query that needs them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_written: dict[tuple[str, str, str], tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share; on a local master without one, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _folders.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="threadloom-"))


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` plans, written as Parquet in the shared folder when an application first asks for it.

    Branches of a plan, and later queries, read it instead of deriving it
    again, and a lost executor costs no more than the files it was reading.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
        df = build()
        df.write.parquet(path)
        _written[key] = (path, df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for key in [k for k in _written if k[0] == spark.sparkContext.applicationId]:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop(key)[0])
        p.getFileSystem(conf).delete(p, True)
