"""The write path in one run (Q17): admission, routing, settled events, chunks and facts, merging, binding, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.fixtures import TURNS, turns
from ..sources.views import once
from .graph import edges
from .guard import TRUSTED, actor_key, admission_sql, admissions, credits, gates
from .memory import bindings, chunk_summary, upsert_in, upsert_sql
from .router import CHAT, chat, route, router_sql
from .text import _FACTS, atomic_facts, fact_key
from .vectors import mean_vectors

#: When the final flush settles an event.
AT_END = 1 << 60
_GROUP = ["scope_key", "settled", "thread_key", "segment_key", "anchor"]


def settled_events(t: DataFrame, routed: DataFrame) -> DataFrame:
    """scope_key, thread_key, segment_key, anchor, turn, settled, actor_key, vec: every event that the router let go, named by the first turn of its segment."""
    starts = routed.where("kind = 'routed' and thread_key <> ''").groupBy("scope_key", "segment_key").agg(F.min("turn").alias("start"))
    done = routed.where("kind = 'committed'").select("scope_key", "turn", "thread_key", "segment_key", F.when(F.col("at_turn") == 0, F.lit(AT_END)).otherwise(F.col("at_turn")).alias("settled"))
    who = t.select("turn", actor_key().alias("actor_key"), "vec", "user_input")
    anchor = F.concat("scope_key", F.lit("|S:"), F.col("start").cast("string"))
    return done.join(starts, ["scope_key", "segment_key"]).join(who, "turn").withColumn("anchor", anchor).drop("start")


def committed(ev: DataFrame) -> DataFrame:
    """The memories that settled events write, numbered in the order of their scope.

    Events that are settled at one turn and belong to one segment are a chunk.
    Each of its facts is a memory of its one actor, or else of the scope, at
    the mean vector of where it was said; the chunk itself is one of its
    thread, at the mean of its facts.
    """
    f = atomic_facts(ev.select(F.col("turn").alias("id"), F.col("user_input").alias("text"))).select(F.col("id").alias("turn"), "pos", "fact")
    said = ev.join(f, "turn").withColumn("k", fact_key(F.col("fact")))
    said = said.withColumn("g", F.xxhash64(*_GROUP)).withColumn("gk", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in _GROUP], "k"))
    longest = F.max_by("fact", F.struct(F.char_length("fact"), -F.col("turn"), -F.col("pos")))
    facts = said.groupBy("gk", *_GROUP).agg(longest.alias("text"), F.min(F.struct("turn", "pos")).alias("first"), F.array_sort(F.collect_set("turn")).alias("turns"), F.array_sort(F.collect_set("actor_key")).alias("actors"))
    facts = facts.join(mean_vectors(said, "gk", "vec").withColumnRenamed("m", "vec"), "gk")
    single = F.size("actors") == 1
    rows = facts.select(*_GROUP, F.lit("fact").alias("kind"), F.when(single, "actor").otherwise("scope").alias("memory_scope"), F.when(single, F.col("actors")[0]).alias("actor_key"), "text", "turns", "vec", "first")
    keyed = facts.withColumn("ck", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in _GROUP]))
    ends = ev.groupBy(*_GROUP).agg(F.array_sort(F.collect_set("turn")).alias("turns"), F.array_sort(F.collect_set("actor_key")).alias("actors"))
    chunk = keyed.groupBy("ck", *_GROUP).agg(F.count("*").alias("n"), F.min("first").alias("first")).join(mean_vectors(keyed, "ck", "vec").withColumnRenamed("m", "vec"), "ck").join(ends, _GROUP)
    chunk = chunk.select(*_GROUP, F.lit("chunk").alias("kind"), F.lit("thread").alias("memory_scope"), F.lit(None).cast("string").alias("actor_key"), chunk_summary(F.col("turns"), F.col("n"), F.size("actors")).alias("text"), "turns", "vec", "first")
    every = chunk.unionByName(rows)
    start = F.min("first").over(Window.partitionBy(*_GROUP))
    order = Window.partitionBy("scope_key").orderBy("settled", "start", "thread_key", "segment_key", "kind", "first")
    return every.withColumn("start", start).withColumn("mem_no", F.row_number().over(order).cast("long")).drop("first", "start")


def merged(mem: DataFrame) -> DataFrame:
    """The memories with stored_no, the earlier one that a fact was merged into or its own number; chunks are never merged."""
    bucket = F.concat_ws("\x1f", "scope_key", "memory_scope", F.coalesce("actor_key", F.lit("")))
    facts = mem.where("kind = 'fact'").select("scope_key", bucket.alias("b"), F.col("mem_no").alias("mem_id"), "vec")
    up = facts.select("scope_key", "b", "mem_id").join(upsert_in(facts), ["b", "mem_id"]).select("scope_key", F.col("mem_id").alias("mem_no"), F.col("stored_id").alias("stored_no"))
    return mem.join(up, ["scope_key", "mem_no"], "left").withColumn("stored_no", F.coalesce("stored_no", "mem_no"))


class Written:
    """What one run over the turns leaves behind."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = chat(turns(spark, sf_dir))
        may = gates(credits(admissions(t), TRUSTED), TRUSTED).where("write").select("turn")
        t = once(spark, sf_dir, "ingest-turns", lambda: t.join(may, "turn", "left_semi"))
        self.turns, self.routed = t, once(spark, sf_dir, "ingest-routed", lambda: route(t))
        self.events = once(spark, sf_dir, "ingest-events", lambda: settled_events(t, self.routed))
        self.memories = once(spark, sf_dir, "ingest-memories", lambda: merged(once(spark, sf_dir, "ingest-committed", lambda: committed(self.events))))

    def bound(self) -> DataFrame:
        """scope_key, stored_no, anchor, weight: how often a stored memory was written under a topic."""
        b = self.memories.select(F.struct("scope_key", "stored_no").alias("mem_id"), "anchor", F.lit(1.0).alias("amount"))
        return bindings(b).select("mem_id.scope_key", "mem_id.stored_no", "anchor", "weight")

    def edges(self) -> DataFrame:
        """Edges of every thread's steps from topic to topic, in the order in which its events were settled."""
        prev = F.lag("anchor").over(Window.partitionBy("thread_key").orderBy("settled", "turn"))
        steps = self.events.withColumn("src", prev).where("src is not null and src <> anchor")
        return edges(steps.select("src", F.col("anchor").alias("dst"), F.lit("transition").alias("kind"), F.lit(0.12).alias("amount"), "turn"))


def _ingest_sql() -> str:
    said = f"SELECT * REPLACE (CASE WHEN turn % 4 = 2 THEN ({list(CHAT)!r})[(turn // 4) % {len(CHAT)} + 1] ELSE user_input END AS user_input) FROM turns"
    group = "scope_key, settled, thread_key, segment_key, anchor"
    mean = "list_transform(range(1, 65), lambda i: list_avg(list_transform({v}, lambda x: x[i])))"
    return f"""WITH {TURNS}, ctn AS MATERIALIZED ({said}), {admission_sql(TRUSTED.live_credit).replace("FROM turns)", "FROM ctn)")}, wtt AS MATERIALIZED (SELECT c.* FROM ctn c JOIN blocks b USING (turn) WHERE b.blocked_until <= b.ts AND b.after >= 0.75), {router_sql('wtt', chatty=False)},
sg AS (SELECT scope_key, segment_key, min(turn) AS start FROM rt GROUP BY ALL),
ie AS MATERIALIZED (SELECT c.scope_key, CASE WHEN at_turn = 0 THEN 1152921504606846976 ELSE at_turn END AS settled, c.thread_key, c.segment_key, c.scope_key || '|S:' || sg.start AS anchor, c.turn, r.actor, r.vec FROM com c JOIN sg USING (scope_key, segment_key) JOIN rin r USING (scope_key, turn)),
messages AS (SELECT turn AS id, text, 'user' AS role FROM rin), {_FACTS},
iff AS (SELECT ie.*, facts.pos, facts.fact, regexp_replace(lower(facts.fact), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS k FROM ie JOIN facts ON facts.id = ie.turn),
ifa AS MATERIALIZED (SELECT {group}, k, arg_max(fact, {{'l': length(fact), 't': -turn, 'p': -pos}}) AS text, min({{'turn': turn, 'pos': pos}}) AS first, list_sort(list(DISTINCT turn)) AS turns, list_sort(list(DISTINCT actor)) AS actors, list(vec) AS vs FROM iff GROUP BY ALL),
ifv AS MATERIALIZED (SELECT * EXCLUDE (vs), {mean.format(v='vs')} AS vec FROM ifa),
ien AS (SELECT {group}, list_sort(list(DISTINCT turn)) AS turns, list_sort(list(DISTINCT actor)) AS actors FROM ie GROUP BY ALL), ich0 AS (SELECT {group}, count(*) AS n, min(first) AS first, list(vec) AS vs FROM ifv GROUP BY ALL), ich AS (SELECT * EXCLUDE (vs), {mean.format(v='vs')} AS vec FROM ich0),
iall AS (SELECT {group}, 'fact' AS kind, CASE WHEN len(actors) = 1 THEN 'actor' ELSE 'scope' END AS memory_scope, CASE WHEN len(actors) = 1 THEN actors[1] END AS actor_key, text, turns, vec, first FROM ifv
  UNION ALL SELECT {group}, 'chunk', 'thread', NULL, CASE WHEN len(e.turns) = 1 THEN '线程片段：第' || e.turns[1] || '轮，' || n || '条事实，' || len(e.actors) || '位参与者。' ELSE '线程片段：第' || e.turns[1] || '至' || e.turns[-1] || '轮，' || n || '条事实，' || len(e.actors) || '位参与者。' END, e.turns, c.vec, c.first FROM ich c JOIN ien e USING ({group})),
imn AS MATERIALIZED (SELECT * EXCLUDE (first, start), row_number() OVER (PARTITION BY scope_key ORDER BY settled, start, thread_key, segment_key, kind, first) AS mem_no FROM (SELECT *, min(first) OVER (PARTITION BY {group}) AS start FROM iall)),
{upsert_sql("SELECT concat_ws(chr(31), scope_key, memory_scope, coalesce(actor_key, '')) AS b, mem_no AS mem_id, vec FROM imn WHERE kind = 'fact'")},
iw AS MATERIALIZED (SELECT imn.*, coalesce(up.stored_id, mem_no) AS stored_no FROM imn LEFT JOIN up ON kind = 'fact' AND up.b = concat_ws(chr(31), scope_key, memory_scope, coalesce(actor_key, '')) AND up.mem_id = mem_no)"""


_W = _ingest_sql()
_SHOWN = ["scope_key", "mem_no", "stored_no", "kind", "memory_scope", "actor_key", "thread_key", "anchor", "text", "turns"]


@query("q17_ingest", f"{_W} SELECT {', '.join(_SHOWN)}, CASE WHEN settled < 1152921504606846976 THEN settled END AS settled FROM iw")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory that the turns write: when it was settled, for whom, under which topic, and what it was merged into."""
    m = Written(spark, sf_dir).memories
    return m.select(*_SHOWN, F.when(F.col("settled") < AT_END, F.col("settled")).alias("settled"))


@query("q17_bindings", f"{_W} SELECT scope_key, stored_no, anchor, least(64.0, count(*))::DOUBLE AS weight FROM iw GROUP BY ALL")
def q17_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Written(spark, sf_dir).bound()


@query("q17_edges", f"{_W}, st AS (SELECT lag(anchor) OVER (PARTITION BY thread_key ORDER BY settled, turn) AS src, anchor AS dst, turn FROM ie) SELECT src, dst, round(least(8.0, 0.12 * count(*)), 6)::DOUBLE AS transition, count(*) AS support, max(turn) AS last_turn FROM st WHERE src IS NOT NULL AND src <> dst GROUP BY ALL")
def q17_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Written(spark, sf_dir).edges().select("src", "dst", F.round("transition", 6).alias("transition"), "support", "last_turn")
