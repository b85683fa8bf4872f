"""Snapshots, log, checkpoints, recovery and import."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT
from .fixtures import MEMORIES, TURNS, memories, turns
from .views import shared_folder

_M = f"WITH {TURNS}, {MEMORIES}"


class Snapshots:
    """Versions of named tables under one folder; a pointer names the current one.

    A version is complete before the pointer is swapped, so a crash leaves the
    old one current.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        p = self._path(f"{self.root}/pointers")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def save(self, tables: dict[str, DataFrame]) -> str:
        done = self._versions()
        version = f"{len(done):08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        self._fs.create(self._path(f"{self.root}/pointers/{version}"), False).close()
        return version

    def load(self, name: str) -> DataFrame:
        """The table as the newest version that has it left it."""
        for v in reversed(self._versions()):
            at = f"{self.root}/versions/{v}/{name}"
            if self._fs.exists(self._path(at)):
                return self.spark.read.parquet(at)
        raise KeyError(name)


class Saver:
    """Tables that changed since they were last written; a flush writes those, and no others, as one version."""

    def __init__(self, snapshots: Snapshots):
        self.snapshots, self.dirty = snapshots, {}

    def mark(self, name: str, df: DataFrame) -> None:
        self.dirty[name] = df

    def flush(self) -> list[str]:
        done = sorted(self.dirty)
        if done:
            self.snapshots.save(self.dirty)
        self.dirty = {}
        return done


class Checkpoints:
    """States by scope, written when enough turns have passed since the last time; the log is needed only past them."""

    def __init__(self, snapshots: Snapshots, every: int = 24):
        self.snapshots, self.every, self.last = snapshots, every, 0

    def due(self, turn: int) -> bool:
        return turn - self.last >= self.every

    def write(self, log: DataFrame, turn: int) -> None:
        """The last state of each scope up to ``turn``."""
        upto = log.where(F.col("turn") <= turn).groupBy("scope_key").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
        self.snapshots.save({"checkpoint": upto})
        self.last = turn


@query("l1_atomic_replace", f"{_M} SELECT count(*) AS n, max(turn) AS last_turn FROM mem WHERE turn % 2 = 0")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions are written; what is read is the second."""
    mem = memories(turns(spark, sf_dir)).select("mem_id", "turn")
    s = Snapshots(spark, f"{shared_folder(spark)}/l1-{uuid.uuid4().hex}")
    s.save({"memories": mem})
    s.save({"memories": mem.where("turn % 2 = 0")})
    return s.load("memories").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query("l2_snapshot", f"{_M} SELECT mem_id, scope_key, anchor, memory_scope, text FROM mem")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Snapshots(spark, f"{shared_folder(spark)}/l2-{uuid.uuid4().hex}")
    s.save({"memories": memories(turns(spark, sf_dir))})
    return s.load("memories").select("mem_id", "scope_key", "anchor", "memory_scope", "text")


def wal(mem: DataFrame) -> DataFrame:
    """seq, turn, scope_key, state: one record a turn; every seventh comes twice and every fifth late."""
    one = mem.select(F.col("turn").alias("seq"), "turn", "scope_key", F.concat(F.lit("s"), "turn").alias("state"))
    return one.unionByName(one.where("seq % 7 = 0")).withColumn("arrival", F.when(F.col("seq") % 5 == 0, F.col("seq") + 3).otherwise(F.col("seq")))


def load_after(log: DataFrame, seq: int) -> DataFrame:
    """Records past a sequence number, each once."""
    return log.where(F.col("seq") > seq).select("seq", "turn", "scope_key", "state").distinct()


_WAL = "wal AS (SELECT turn AS seq, turn, scope_key, 's' || turn AS state FROM mem)"


@query("l3_dirty_flush", f"{_M} SELECT 'actors' AS name, count(DISTINCT actor_key) AS n, 1 AS writes FROM mem UNION ALL SELECT 'memories', count(*), 2 FROM mem")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables change, then one of them again: each flush writes what changed before it, and what is read is the last of each."""
    mem = memories(turns(spark, sf_dir))
    saver = Saver(Snapshots(spark, f"{shared_folder(spark)}/l3-{uuid.uuid4().hex}"))
    saver.mark("memories", mem.where("turn <= 24").select("mem_id"))
    saver.mark("actors", mem.select("actor_key").distinct())
    done = saver.flush()
    saver.mark("memories", mem.select("mem_id"))
    done += saver.flush() + saver.flush()
    out = None
    for name in sorted(set(done)):
        n = saver.snapshots.load(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(done.count(name)).alias("writes"))
        out = n if out is None else out.unionByName(n)
    return out


@query("l4_wal", f"{_M}, {_WAL} SELECT seq, turn, scope_key, state FROM wal WHERE seq > 24")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_after(wal(memories(turns(spark, sf_dir))), 24)


@query("l5_checkpoint", f"{_M}, {_WAL} SELECT scope_key, arg_max(state, seq) AS state, max(seq) AS seq, 4 AS written FROM wal WHERE turn <= 96 GROUP BY 1")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint whenever 24 turns have passed, over the first hundred; the last one as it is read."""
    log = load_after(wal(memories(turns(spark, sf_dir))), 0)
    cp, written = Checkpoints(Snapshots(spark, f"{shared_folder(spark)}/l5-{uuid.uuid4().hex}")), 0
    for turn in range(1, 101):
        if cp.due(turn):
            cp.write(log, turn)
            written += 1
    return cp.snapshots.load("checkpoint").select("scope_key", "state", "seq", F.lit(written).alias("written"))


def recover(checkpoint: DataFrame, log: DataFrame) -> DataFrame:
    """scope_key, state, seq: the checkpoint's state, or the last one that the log has past it."""
    both = checkpoint.select("scope_key", "state", "seq").unionByName(log.select("scope_key", "state", "seq"))
    return both.groupBy("scope_key").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


@query("l6_replay", f"{_M} SELECT scope_key, 's' || max(turn) AS state, max(turn) AS seq FROM mem GROUP BY 1")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint half way and the log after it give what a straight run ends with."""
    log = wal(memories(turns(spark, sf_dir)))
    half = log.where("seq <= 100").groupBy("scope_key").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
    return recover(half, load_after(log, 100))


@query("l7_shutdown", f"{_M}, {_WAL} SELECT 'actors' AS name, count(DISTINCT actor_key) AS n, max(turn) AS last FROM mem UNION ALL SELECT 'checkpoint', count(DISTINCT scope_key), max(seq) FROM wal UNION ALL SELECT 'memories', count(*), max(turn) FROM mem")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shutdown: the guard's state, then what is dirty, then a checkpoint although none is due; all of it read back."""
    mem = memories(turns(spark, sf_dir))
    s = Snapshots(spark, f"{shared_folder(spark)}/l7-{uuid.uuid4().hex}")
    s.save({"actors": mem.groupBy("actor_key").agg(F.max("turn").alias("last"))})
    saver = Saver(s)
    saver.mark("memories", mem.select("mem_id", F.col("turn").alias("last")))
    saver.flush()
    Checkpoints(s).write(load_after(wal(mem), 0), 1 << 60)
    out = None
    for name, last in (("actors", "last"), ("memories", "last"), ("checkpoint", "seq")):
        n = s.load(name).agg(F.count("*").alias("n"), F.max(last).alias("last")).select(F.lit(name).alias("name"), "n", "last")
        out = n if out is None else out.unionByName(n)
    return out


@query("l8_index_rebuild", "SELECT * FROM (VALUES ('loaded', true, true), ('rebuilt', true, true)) v(index, enough, all_indexed)")
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is saved and loaded, and one rebuilt from the rows where nothing was saved: both hold all rows and find nine tenths of the exact result."""
    from ..operators.vectors import VectorIndex, _asked, knn_topk, recall_of

    q, data = _asked(spark, sf_dir)
    path = f"{shared_folder(spark)}/l8-{uuid.uuid4().hex}"
    VectorIndex.create(data).save(path)
    exact, out = knn_topk(q, data, 48), None
    for name, index in (("loaded", load_or_rebuild(spark, path, data)), ("rebuilt", load_or_rebuild(spark, f"{path}-missing", data))):
        n = index.rows.agg(F.count("*").alias("n")).join(data.agg(F.count("*").alias("all")), F.lit(True)).select((F.col("n") == F.col("all")).alias("all_indexed"))
        r = recall_of(index.search(q, 48), exact).select(F.lit(name).alias("index"), (F.col("recall") >= 0.9).alias("enough")).join(n, F.lit(True))
        out = r if out is None else out.unionByName(r)
    return out


def load_or_rebuild(spark: SparkSession, path: str, data: DataFrame):
    """The index at ``path``, or a new one over ``data`` if there is none."""
    from ..operators.vectors import VectorIndex

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return VectorIndex.load(spark, path) if there else VectorIndex.create(data)


#: The tab-separated predictor format of earlier stores.
PREDICTOR = ["TPR2", "TOPIC\t3\t5\t0.75", "TOPIC\t4\t6\t0.25", "NEXT\t5\t6\t1.5", "TRANS\t3\t4\t0.12\t2", "STAT\tturns\t9", "bad line", "TOPIC\tx\t1\t1"]


def predictor(lines: DataFrame) -> DataFrame:
    """kind, src, dst, weight of the lines that are well formed."""
    f = F.split("line", "\t")
    num = [F.get(f, i).try_cast("double") for i in (1, 2, 3)]
    df = lines.select(F.get(f, 0).alias("kind"), num[0].cast("long").alias("src"), num[1].cast("long").alias("dst"), num[2].alias("weight"))
    return df.where("kind in ('TOPIC', 'NEXT', 'TRANS') and src is not null and dst is not null and weight is not null")


@query("l9_legacy_predictor", "SELECT * FROM (VALUES ('TOPIC', 3::BIGINT, 5::BIGINT, 0.75::DOUBLE), ('TOPIC', 4, 6, 0.25), ('NEXT', 5, 6, 1.5), ('TRANS', 3, 4, 0.12)) v(kind, src, dst, weight)")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictor(spark.createDataFrame([(x,) for x in PREDICTOR], "line string"))


def binary_records(df: DataFrame) -> DataFrame:
    """id, text, vec from length-prefixed records: u32 id, u16 length and text, u32 length and float32 vector, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob in b.column(0).to_pylist():
                at = 0
                while at + 6 <= len(blob):
                    ident, n = struct.unpack_from("<IH", blob, at)
                    text = blob[at + 6 : at + 6 + n].decode("utf-8", "replace")
                    (dim,) = struct.unpack_from("<I", blob, at + 6 + n)
                    rows.append((ident, text, list(struct.unpack_from(f"<{dim}f", blob, at + 10 + n))))
                    at += 10 + n + 4 * dim
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.float32()))], names=["id", "text", "vec"])

    return df.mapInArrow(run, "id long, text string, vec array<float>")


@query("l10_binary_records", "SELECT vec_id AS id, 'v' || vec_id AS text, len(embedding)::INT AS dim FROM embeddings")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, packed into binary records and read back."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = f"v{i}".encode()
                out.append(struct.pack("<IH", i, len(text)) + text + struct.pack(f"<I{len(v)}f", len(v), *v))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["blob"])

    blobs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(pack, "blob binary")
    return binary_records(blobs).select("id", "text", F.size("vec").alias("dim"))


@query("l12_config", "SELECT * FROM (VALUES ('guard.decay', 0.985::DOUBLE), ('graph.decay', 0.995), ('retrieval.family_at', 0.84), ('missing', NULL)) v(path, value)")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, DEFAULT.get(p)) for p in ("guard.decay", "graph.decay", "retrieval.family_at", "missing")], "path string, value double")


__all__ = ["Snapshots", "binary_records", "load_after", "predictor", "recover", "wal"]
