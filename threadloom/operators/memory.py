"""Memories: grouping of committed events, merging, visibility, binding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT, Graph
from ..plans.fold import keyed_fold
from ..sources.fixtures import MEMORIES, TURNS, memories, turns
from .segments import direction
from .text import _FACTS, atomic_facts, fact_key, remove_cot

_M = f"WITH {TURNS}, {MEMORIES}"
_EVENTS = "messages AS (SELECT turn AS id, user_input AS text, 'user' AS role FROM turns)"
_EF = f"{_M}, {_EVENTS}, {_FACTS}, ef AS (SELECT mem.scope_key, mem.thread_key, mem.anchor, mem.actor_key, mem.turn, facts.fact, regexp_replace(lower(facts.fact), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS k, mem.vec FROM mem LEFT JOIN facts ON facts.id = mem.turn)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each fact of each turn; a turn without facts has one with a null fact."""
    mem = memories(turns(spark, sf_dir))
    f = atomic_facts(mem.select(F.col("turn").alias("id"), "text")).select(F.col("id").alias("turn"), "pos", "fact")
    return mem.select("scope_key", "thread_key", "anchor", "actor_key", "turn", "vec").join(f, "turn", "left")


def chunk_groups(ev: DataFrame) -> DataFrame:
    """scope, thread, anchor with its turns, actors and facts; of facts with one key the longest text, the first on a tie."""
    g = ["scope_key", "thread_key", "anchor"]
    best = F.max_by("fact", F.struct(F.char_length("fact"), -F.col("turn"), -F.col("pos")))
    per = ev.where("fact is not null").groupBy(*g, fact_key(F.col("fact")).alias("k")).agg(best.alias("fact"), F.min(F.struct("turn", "pos")).alias("first"))
    facts = per.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "k", "fact"))), lambda s: s["fact"]).alias("facts"))
    who = ev.groupBy(*g).agg(F.array_sort(F.collect_set("turn")).alias("turns"), F.array_sort(F.collect_set("actor_key")).alias("actors"))
    return who.join(facts, g, "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))


@query("m1_chunks", f"{_EF} SELECT scope_key, thread_key, anchor, count(DISTINCT turn) AS n_turns, count(DISTINCT actor_key) AS n_actors, count(DISTINCT k) AS n_facts, min(turn) AS first_turn, max(turn) AS last_turn FROM ef GROUP BY ALL")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_groups(events(spark, sf_dir))
    return c.select("scope_key", "thread_key", "anchor", *[F.size(x).cast("long").alias(f"n_{x}") for x in ("turns", "actors", "facts")], F.array_min("turns").alias("first_turn"), F.array_max("turns").alias("last_turn"))


def chunk_summary(turns_: Column, n_facts: Column, n_actors: Column) -> Column:
    a, b, who = F.array_min(turns_), F.array_max(turns_), F.greatest(F.lit(1).cast("long"), n_actors.cast("long"))
    one = F.format_string("线程片段：第%d轮，%d条事实，%d位参与者。", a, n_facts, who)
    many = F.format_string("线程片段：第%d至%d轮，%d条事实，%d位参与者。", a, b, n_facts, who)
    none = F.format_string("线程片段：%d条事实，%d位参与者。", n_facts, who)
    return F.when(a.isNull() | (a <= 0), none).when(a == b, one).otherwise(many)


@query("m2_chunk_summary", f"{_EF}, c AS (SELECT scope_key, thread_key, min(turn) AS a, max(turn) AS b, count(DISTINCT k) AS f, count(DISTINCT actor_key) AS n FROM ef GROUP BY ALL) SELECT thread_key, CASE WHEN a = b THEN '线程片段：第' || a || '轮，' || f || '条事实，' || n || '位参与者。' ELSE '线程片段：第' || a || '至' || b || '轮，' || f || '条事实，' || n || '位参与者。' END AS summary FROM c")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_groups(events(spark, sf_dir))
    return c.select("thread_key", chunk_summary(F.col("turns"), F.size("facts"), F.size("actors")).alias("summary"))


def commit_rows(ev: DataFrame) -> DataFrame:
    """The memories a chunk commits: itself for its thread, each fact for its one actor or else for the scope."""
    c = chunk_groups(ev)
    single = F.size("actors") == 1
    chunk = c.select("scope_key", "thread_key", F.lit("chunk").alias("kind"), F.lit("thread").alias("memory_scope"), F.lit(None).cast("string").alias("actor_key"), chunk_summary(F.col("turns"), F.size("facts"), F.size("actors")).alias("text"))
    facts = c.select("scope_key", "thread_key", F.lit("fact").alias("kind"), F.when(single, "actor").otherwise("scope").alias("memory_scope"), F.when(single, F.col("actors")[0]).alias("actor_key"), F.explode("facts").alias("text"))
    return chunk.unionByName(facts)


@query("m3_commit", f"{_EF}, c AS (SELECT scope_key, thread_key, count(DISTINCT actor_key) AS n, count(DISTINCT k) AS f FROM ef GROUP BY ALL) SELECT thread_key, 'chunk' AS kind, 'thread' AS memory_scope, 1::BIGINT AS n FROM c UNION ALL SELECT thread_key, 'fact', CASE WHEN n = 1 THEN 'actor' ELSE 'scope' END, f FROM c WHERE f > 0")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_rows(events(spark, sf_dir)).groupBy("thread_key", "kind", "memory_scope").agg(F.count("*").alias("n"))


def visible(mem: Column, who: Column) -> Column:
    """Whether a memory may be seen: same scope, and for thread and actor memories the same thread or actor."""
    kind = mem["memory_scope"]
    own = F.when(kind == "thread", mem["thread_key"] == who["thread_key"]).when(kind == "actor", mem["actor_key"] == who["actor_key"]).otherwise(True)
    return (mem["scope_key"] == who["scope_key"]) & F.coalesce(own, F.lit(False))


def count_visible(mem: DataFrame, who: DataFrame) -> DataFrame:
    """``who`` (scope_key, thread_key, actor_key) with ``seen``, how many memories are ``visible`` to it; those who see none are left out.

    All who share a scope, thread or actor see the same of it, so memories are counted by these and no pair of a memory and one who sees it
    is made.  Scopes and threads, which any number of rows share, are few (3 and 18 in the views at every size) and go to every task; actors
    meet by key.
    """
    kind = F.coalesce("memory_scope", F.lit(""))
    seen = {"thread": mem.where(kind == "thread"), "actor": mem.where(kind == "actor"), "scope": mem.where(~kind.isin("thread", "actor"))}
    for k, m in seen.items():
        on = sorted({"scope_key", f"{k}_key"})
        n = m.groupBy(*on).agg(F.count("*").alias(f"_{k}"))
        who = who.join(n if k == "actor" else F.broadcast(n), on, "left")
    return who.withColumn("seen", sum(F.coalesce(f"_{k}", F.lit(0)) for k in seen)).where("seen > 0").drop(*[f"_{k}" for k in seen])


def merge_key() -> Column:
    """The bucket inside which memories may merge."""
    own = F.when(F.col("memory_scope") == "thread", F.col("thread_key")).when(F.col("memory_scope") == "actor", F.col("actor_key")).otherwise("")
    return F.concat_ws("\x1f", "scope_key", "memory_scope", own)


@query("m4_merge_argmax", f"{_M}, k AS (SELECT mem_id, vec, concat_ws(chr(31), scope_key, memory_scope, CASE memory_scope WHEN 'thread' THEN thread_key WHEN 'actor' THEN actor_key ELSE '' END) AS b FROM mem), p AS (SELECT a.mem_id, b.mem_id AS into_id, list_cosine_similarity(a.vec, b.vec) AS sim, row_number() OVER (PARTITION BY a.mem_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.mem_id) AS n FROM k a JOIN k b ON a.b = b.b AND b.mem_id < a.mem_id) SELECT mem_id, into_id, round(sim, 6) AS sim FROM p WHERE n = 1 AND sim >= 0.95")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each memory the most similar earlier one of its bucket, if they are alike enough to merge."""
    return nearest_earlier(memories(turns(spark, sf_dir)).select("mem_id", "vec", merge_key().alias("b"))).withColumn("sim", F.round("sim", 6))


#: Memories of one block; a bucket has as many blocks as it needs, and each task holds two.
BLOCK = 4096


def nearest_earlier(rows: DataFrame, at: float = DEFAULT.graph.merge_at) -> DataFrame:
    """mem_id, into_id, sim: for each row (mem_id, vec, b) the most similar one of its bucket with a lower id, the lowest id on a tie.

    A bucket is cut into blocks; each pair of blocks is one task's matrix
    product, from which at most one row for each later memory comes back.
    """
    sizes = rows.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    r = rows.join(sizes, "b").withColumn("own", F.pmod(F.xxhash64("mem_id"), F.col("blocks").cast("long")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    late = r.select("b", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"), "mem_id", "vec")
    early = r.select("b", every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "mem_id", "vec")

    def solve(t: pa.Table) -> pa.Table:
        asks, ids = np.asarray(t["asks"]), np.asarray(t["mem_id"])
        v = np.asarray(t["vec"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        n = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        data = np.flatnonzero(~asks)
        data = data[np.argsort(ids[data], kind="stable")]
        out: list[tuple[int, int, float]] = []
        for q in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 512)):
            sims = v[q] @ v[data].T
            sims[ids[data][None, :] >= ids[q][:, None]] = -2.0
            best = np.round(sims, 9).argmax(1) if len(data) else np.zeros(len(q), np.int64)
            top = sims[np.arange(len(q)), best] if len(data) else np.full(len(q), -2.0)
            out += [(int(ids[x]), int(ids[data[b]]), float(c)) for x, b, c in zip(q, best, top, strict=True) if c >= at]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["mem_id", "into_id", "sim"])

    found = late.unionByName(early).groupBy("b", "i", "j").applyInArrow(solve, "mem_id long, into_id long, sim double")
    best = F.max(F.struct(F.round("sim", 9).alias("o"), (-F.col("into_id")).alias("minus"), "sim"))
    return found.groupBy("mem_id").agg(best.alias("x")).select("mem_id", (-F.col("x.minus")).alias("into_id"), "x.sim")


class Store:
    """The memories of one merge bucket, in order of their ids."""

    def __init__(self, _key: object = None):
        self.ids: list[int] = []
        self.rows = np.zeros((0, 0))

    def add(self, ident: int, v: np.ndarray) -> None:
        if len(self.ids) == len(self.rows):
            grown = np.zeros((max(16, 2 * len(self.ids)), len(v)))
            if self.ids:
                grown[: len(self.ids)] = self.rows
            self.rows = grown
        self.rows[len(self.ids)] = v
        self.ids.append(ident)


def merge_step(cfg: Graph):
    """Upsert: into the most similar stored memory, the lowest id on a tie, or a new one.  Stored vectors stay as first written."""

    def step(s: Store, row: dict) -> list[tuple]:
        v = direction(np.asarray(row["vec"], np.float64))
        if s.ids:
            sims = s.rows[: len(s.ids)] @ v
            at = int(sims.argmax())
            if sims[at] >= cfg.merge_at:
                return [(row["mem_id"], s.ids[at], True)]
        s.add(row["mem_id"], v)
        return [(row["mem_id"], row["mem_id"], False)]

    return step


def upsert(mem: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """mem_id, stored_id, merged: the sequence of inserts and merges."""
    return upsert_in(mem.select(merge_key().alias("b"), "mem_id", "vec"), cfg).drop("b")


def upsert_in(rows: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """b, mem_id, stored_id, merged: the same for rows whose bucket b is known; ids count inside a bucket."""
    step = merge_step(cfg)
    return keyed_fold(rows.select("b", "mem_id", "vec"), "b", ["mem_id"], Store, lambda s, row: [(row["b"], *r) for r in step(s, row)], "b string, mem_id long, stored_id long, merged boolean")


# Earlier memories of the bucket by likeness; the first of them that is stored decides.
def upsert_sql(src: str) -> str:
    """``upsert`` as ``up``, over ``src`` of b (the bucket), mem_id and vec."""
    return f"""uk AS MATERIALIZED ({src}),
uc AS (SELECT a.b, a.mem_id, list({{'id': b.mem_id, 's': list_cosine_similarity(a.vec, b.vec)}} ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.mem_id) AS near FROM uk a JOIN uk b ON a.b = b.b AND b.mem_id < a.mem_id GROUP BY ALL),
ux AS (SELECT uk.b, uk.mem_id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY uk.b ORDER BY uk.mem_id) AS n FROM uk LEFT JOIN uc USING (b, mem_id)),
up AS MATERIALIZED (WITH RECURSIVE f AS (
  SELECT b, n, mem_id, mem_id AS stored_id, false AS merged, [mem_id] AS ids FROM ux WHERE n = 1
  UNION ALL
  SELECT b, n, mem_id, CASE WHEN hit.s >= 0.95 THEN hit.id ELSE mem_id END, coalesce(hit.s >= 0.95, false), CASE WHEN hit.s >= 0.95 THEN ids ELSE list_append(ids, mem_id) END
  FROM (SELECT x.b, x.n, x.mem_id, ids, list_filter(x.near, lambda c: list_contains(ids, c.id))[1] AS hit FROM f JOIN ux x ON x.b = f.b AND x.n = f.n + 1))
  SELECT b, mem_id, stored_id, merged FROM f)"""


_BUCKETS = "SELECT mem_id, vec, concat_ws(chr(31), scope_key, memory_scope, CASE memory_scope WHEN 'thread' THEN thread_key WHEN 'actor' THEN actor_key ELSE '' END) AS b FROM mem"


@query("m4_upsert", f"{_M}, {upsert_sql(_BUCKETS)} SELECT mem_id, stored_id, merged FROM up")
def m4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(memories(turns(spark, sf_dir)))


@query("m5_visible", f"{_M} SELECT t.conv_id, count(*) AS seen FROM (SELECT conv_id, min(room_id) AS room_id, 'u' || conv_id AS u, min(topic) AS tp FROM turns GROUP BY conv_id) t JOIN mem m ON m.scope_key = 'bilibili:' || t.room_id AND (m.memory_scope = 'scope' OR (m.memory_scope = 'thread' AND m.thread_key = 'bilibili:' || t.room_id || '$th:' || (t.tp + 1)) OR (m.memory_scope = 'actor' AND m.actor_key = 'bilibili/room:' || t.room_id || '/uid:' || t.u)) GROUP BY 1")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories each conversation's first state can see."""
    t = turns(spark, sf_dir)
    mem = memories(t)
    who = mem.join(t.select("turn", "conv_id"), "turn").groupBy("conv_id").agg(F.min("scope_key").alias("scope_key"), F.min("actor_key").alias("actor_key"), F.min("topic").alias("topic"))
    who = who.withColumn("thread_key", F.concat("scope_key", F.lit("$th:"), F.col("topic") + 1))
    return count_visible(mem, who).select("conv_id", "seen")


def bindings(pairs: DataFrame, cap: float = 64.0) -> DataFrame:
    """mem_id, anchor, weight: bound amounts added up, at most ``cap``."""
    return pairs.groupBy("mem_id", "anchor").agg(F.least(F.lit(cap), F.sum("amount")).alias("weight"))


_BIND = "bd AS (SELECT into_id AS mem_id, anchor, least(64.0, sum(1.0::DOUBLE)) AS weight FROM (SELECT cluster_id * 10 + topic AS into_id, anchor FROM mem) GROUP BY ALL)"


@query("m6_bind", f"{_M}, {_BIND} SELECT mem_id, arg_max(anchor, weight) FILTER (WHERE true) AS dominant, round(max(weight), 6) AS weight FROM (SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY weight DESC, anchor) = 1) GROUP BY 1")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory's dominant topic; here memories of a cluster and topic count as one that was bound again and again."""
    p = memories(turns(spark, sf_dir)).select((F.col("cluster_id") * 10 + F.col("topic")).alias("mem_id"), "anchor", F.lit(1.0).alias("amount"))
    b = bindings(p)
    first = F.row_number().over(Window.partitionBy("mem_id").orderBy(F.col("weight").desc(), "anchor"))
    return b.withColumn("n", first).where("n = 1").select("mem_id", F.col("anchor").alias("dominant"), F.round("weight", 6).alias("weight"))


def prune(weights: DataFrame, group: str, key: str, cap: int, weight: str = "weight") -> DataFrame:
    """The ``cap`` heaviest positive entries of each group, ties by key."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.round(weight, 9).desc(), key))
    return weights.where(F.col(weight) > 0).withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


@query("m7_prune", f"{_M}, {_BIND} SELECT anchor, mem_id, weight FROM bd QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY weight DESC, mem_id) <= 2")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = memories(turns(spark, sf_dir)).select((F.col("cluster_id") * 10 + F.col("topic")).alias("mem_id"), "anchor", F.lit(1.0).alias("amount"))
    return prune(bindings(p), "anchor", "mem_id", 2)


@query("m8_lines_by_topic", f"{_M} SELECT anchor, count(*) AS n, min(mem_id) AS first_id, max(turn) AS last_turn, string_agg(mem_id::VARCHAR, ',' ORDER BY mem_id) AS ids FROM mem GROUP BY 1")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(turns(spark, sf_dir))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("mem_id")), lambda x: x.cast("string")), ",")
    return m.groupBy("anchor").agg(F.count("*").alias("n"), F.min("mem_id").alias("first_id"), F.max("turn").alias("last_turn"), ids.alias("ids"))


@query("m9_history", f"WITH {TURNS} SELECT turn, user_input AS user_text, replace(CASE WHEN contains(assistant_text, '</think>') THEN substr(assistant_text, instr(assistant_text, '</think>') + 8) ELSE assistant_text END, chr(10) || chr(10), '') AS assistant_text FROM turns")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History keyed by turn; the assistant's hidden reasoning is not kept."""
    a = F.when(F.col("assistant_text") == "", "").otherwise(remove_cot(F.col("assistant_text")))
    return turns(spark, sf_dir).select("turn", F.col("user_input").alias("user_text"), a.alias("assistant_text"))


def sorted_ids(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x > 0)))


@query("m10_sorted_ids", "SELECT conv_id, list_sort(list_distinct(list_filter(list(turn - 1), lambda x: x > 0))) AS ids FROM conversations GROUP BY 1")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.fixtures import read

    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(sorted_ids(F.collect_list(F.col("turn") - 1)).alias("ids"))
