"""Scenario, evaluation and reports (X1-X6), shared scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.fixtures import MEMORIES, TURNS, cosine, memories, norm, read, turns

_T = f"WITH {TURNS}"
_M = f"{_T}, {MEMORIES}"


def timing(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, 95th percentile (linearly interpolated) and maximum."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(key).agg(F.avg(value).alias("mean"), p[0].alias("p50"), p[1].alias("p95"), F.max(value).alias("max"))


@query("x1_percentile", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS \"max\" FROM events GROUP BY 1")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timing(read(spark, sf_dir, "events"), "event_type", "value")
    return t.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")])


MODES = (("shared_statement", 0.32), ("shared_query", 0.28), ("personal_statement", 0.18), ("personal_query", 0.14), ("noise", 0.08))


def scenario(spark: SparkSession, turns_n: int = 240, rooms: int = 3, users: int = 4, topics: int = 6, dim: int = 64, seed: int = 42) -> DataFrame:
    """A seeded conversation: who says what kind of thing about which topic in which room, with its vector."""

    def u(*parts: str | int) -> Column:
        """A reproducible number in [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("turn"), *[F.lit(p) for p in parts]), 11).cast("double") / float(1 << 53)

    df = spark.range(1, turns_n + 1).select(F.col("id").alias("turn"))
    at, mode = 0.0, None
    for name, w in MODES:
        at += w
        mode = F.when(u("mode") < at, name) if mode is None else mode.when(u("mode") < at, name)
    # a room is kept with chance .68: it is the one drawn at the last turn that moved
    moved = F.when((F.col("turn") == 1) | (u("stay") >= 0.68), F.floor(u("room") * rooms) + 1)
    df = df.withColumns({"mode": mode.otherwise(MODES[-1][0]), "moved": moved})
    room = F.last("moved", ignorenulls=True).over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("room_id", F.concat(F.lit("room"), room)).withColumn("user_id", F.concat("room_id", F.lit("_u"), F.floor(u("user") * users) + 1)).withColumn("topic_id", F.floor(u("topic") * topics))

    def vec(*key: Column | str) -> Column:
        """A fixed random direction for a key."""
        return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in key], i), 11).cast("double") / float(1 << 52) - 1.0) * (3.0 / dim) ** 0.5)

    own, noise = F.col("mode").startswith("personal"), F.when(F.col("mode").endswith("query"), 0.02).otherwise(0.03)
    weights = {"topic_id": F.when(own, 0.84).otherwise(0.95), "room_id": F.when(own, 0.08).otherwise(0.10), "user_id": F.when(own, 0.24).otherwise(0.03), "turn": noise}
    df = df.withColumns({f"v_{k}": vec(k) for k in weights})
    parts = F.arrays_zip(*[f"v_{k}" for k in weights])
    df = df.withColumn("raw", F.transform(parts, lambda x: sum((x[f"v_{k}"] * w for k, w in weights.items()), F.lit(0.0)))).withColumn("length", norm(F.col("raw")))
    return df.select("turn", "mode", "room_id", "user_id", "topic_id", F.transform("raw", lambda x: x / F.col("length")).alias("vec"))


@query("x2_scenario", "SELECT * FROM (VALUES ('turns', true), ('modes', true), ('mode_weights', true), ('unit_vectors', true), ('rooms', true), ('room_kept', true), ('users', true), ('topics', true), ('same_topic_alike', true), ('other_topics_not', true), ('same_seed_same_rows', true), ('other_seed_other_rows', true)) v(rule, holds)")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the generator: its ranges, its weights, how long a room is kept, and how vectors lie to each other."""
    s = scenario(spark, 900)
    again, other = scenario(spark, 900), scenario(spark, 900, seed=43)
    n = F.count("*")
    near = lambda share, want: F.abs(share - want) < 0.06
    before = F.lag("room_id").over(Window.orderBy("turn"))
    kept = s.withColumn("kept", before == F.col("room_id"))
    small = s.where("turn <= 60 and mode like 'shared%'").select("turn", "topic_id", "vec")
    pairs = small.join(small.select(F.col("turn").alias("t2"), F.col("topic_id").alias("p2"), F.col("vec").alias("v2")), F.col("turn") < F.col("t2"))
    pairs = pairs.select((F.col("topic_id") == F.col("p2")).alias("same"), cosine(F.col("vec"), F.col("v2")).alias("sim"))
    a = kept.agg(
        (n == 900).alias("turns"), F.bool_and(F.col("mode").isin([m for m, _ in MODES])).alias("modes"), F.array_min(F.array(*[near(F.avg((F.col("mode") == m).cast("int")), w) for m, w in MODES])).alias("mode_weights"),
        F.bool_and(F.abs(norm(F.col("vec")) - 1) < 1e-9).alias("unit_vectors"), (F.countDistinct("room_id") == 3).alias("rooms"), near(F.avg(F.col("kept").cast("int")), 0.68 + 0.32 / 3).alias("room_kept"),
        (F.countDistinct("user_id") == 12).alias("users"), (F.countDistinct("topic_id") == 6).alias("topics"),
    )
    b = pairs.agg((F.min(F.when(F.col("same"), F.col("sim"))) > 0.9).alias("same_topic_alike"), (F.max(F.when(~F.col("same"), F.col("sim"))) < 0.7).alias("other_topics_not"))
    diff = lambda x: s.select("turn", "mode", "vec").exceptAll(x.select("turn", "mode", "vec")).agg(n.alias("n"))
    c = diff(again).select((F.col("n") == 0).alias("same_seed_same_rows"))
    d = diff(other).select((F.col("n") > 800).alias("other_seed_other_rows"))
    row = a.join(b, F.lit(True)).join(c, F.lit(True)).join(d, F.lit(True))
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(x).alias("holds")) for x in row.columns])).alias("r")).select("r.rule", "r.holds")


def turns_in(c: Column) -> Column:
    """Turn numbers that a rendered text names, each once, as first seen."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit("第([0-9]+)轮"), F.lit(1)), lambda x: x.cast("long")), lambda x: x > 0))


def facts_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("fact:(F[0-9]{5,})"), F.lit(1)))


@query("x3_parse_blocks", f"{_T}, x AS (SELECT turn, '第' || turn || '轮 fact:F' || lpad(turn::VARCHAR, 5, '0') || ' 第' || (turn % 5) || '轮 第' || turn || '轮 fact:F1' AS s FROM turns) SELECT turn, CASE WHEN turn % 5 = 0 OR turn % 5 = turn THEN [turn] ELSE [turn, turn % 5] END AS named, ['F' || lpad(turn::VARCHAR, 5, '0')] AS facts FROM x")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("string")
    s = F.concat(F.lit("第"), t, F.lit("轮 fact:F"), F.lpad(t, 5, "0"), F.lit(" 第"), (F.col("turn") % 5).cast("string"), F.lit("轮 第"), t, F.lit("轮 fact:F1"))
    return turns(spark, sf_dir).select("turn", turns_in(s).alias("named"), facts_in(s).alias("facts"))


def fact_text() -> Column:
    """What a statement says, by mode."""
    own = F.col("mode").startswith("personal")
    head = F.concat(F.lit("fact:F"), F.lpad(F.col("turn").cast("string"), 5, "0"), F.lit(" room="), F.col("room_id"))
    shared = F.concat(head, F.lit(" topic="), F.col("topic").cast("string"), F.lit(" mode=shared"))
    personal = F.concat(head, F.lit(" user="), F.col("user_id"), F.lit(" topic="), F.col("topic").cast("string"), F.lit(" mode=personal"))
    return F.when(own, personal).otherwise(shared)


@query("x4_templates", f"{_T} SELECT turn, CASE WHEN turn % 3 = 0 THEN 'fact:F' || lpad(turn::VARCHAR, 5, '0') || ' room=' || room_id || ' user=' || user_id || ' topic=' || topic || ' mode=personal' ELSE 'fact:F' || lpad(turn::VARCHAR, 5, '0') || ' room=' || room_id || ' topic=' || topic || ' mode=shared' END AS said FROM turns")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("mode", F.when(F.col("turn") % 3 == 0, "personal_statement").otherwise("shared_statement"))
    return t.select("turn", fact_text().alias("said"))


def truth(asks: DataFrame, mem: DataFrame) -> DataFrame:
    """qid, expected: the last three memories of the store about the query's room and topic."""
    n = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("turn").desc()))
    last = mem.withColumn("n", n).where("n <= 3").groupBy("anchor").agg(F.array_sort(F.collect_list("turn")).alias("expected"))
    return asks.select("qid", "scope_key", "actor_key", F.col("current").alias("anchor")).join(last, "anchor", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<long>")))


def evaluate(hits: DataFrame, tr: DataFrame, mem: DataFrame) -> DataFrame:
    """For each query (qid, hit): found anything expected, precision, empty, and what leaked from other rooms, threads and actors."""
    m = mem.select(F.col("turn").alias("hit"), F.col("scope_key").alias("hs"), F.col("actor_key").alias("ha"), F.col("anchor").alias("hn"), F.col("memory_scope").alias("hm"))
    j = tr.join(hits.select("qid", "hit").join(m, "hit"), "qid", "left")
    right = F.array_contains("expected", F.col("hit"))
    by = j.groupBy("qid").agg(
        F.coalesce(F.bool_or(right), F.lit(False)).alias("found"), F.count("hit").alias("n"), F.coalesce(F.avg(F.when(F.col("hit").isNotNull(), right.cast("int"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.bool_or(F.col("hs") != F.col("scope_key")), F.lit(False)).alias("cross_room"),
        F.coalesce(F.bool_or((F.col("hm") == "thread") & (F.col("hn") != F.col("anchor"))), F.lit(False)).alias("cross_thread"),
        F.coalesce(F.bool_or((F.col("hm") == "actor") & (F.col("ha") != F.col("actor_key"))), F.lit(False)).alias("cross_actor"),
    )
    return by.withColumn("empty", F.col("n") == 0)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retrieval import Store, rank_memories, rank_turns

    s = Store.of(spark, sf_dir)
    return evaluate(rank_turns(rank_memories(s.recalled()), s.mem), truth(s.ask, s.mem), s.mem)


def _eval_sql() -> str:
    from .retrieval import _RECALL

    return f"""{_RECALL}, l3e AS (SELECT anchor, list_sort(list(turn)) AS expected FROM (SELECT * FROM sto QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY turn DESC) <= 3) GROUP BY 1),
evl AS MATERIALIZED (SELECT q.turn AS qid, coalesce(bool_or(list_contains(l.expected, h.turn)), false) AS found, count(h.turn) AS n, coalesce(avg(list_contains(coalesce(l.expected, []), h.turn)::INT), 0)::DOUBLE AS precision, coalesce(bool_or(h.scope_key <> q.scope_key), false) AS cross_room,
  coalesce(bool_or(h.memory_scope = 'thread' AND h.anchor <> q.anchor), false) AS cross_thread, coalesce(bool_or(h.memory_scope = 'actor' AND h.actor_key <> q.actor_key), false) AS cross_actor FROM ask q LEFT JOIN l3e l ON l.anchor = q.anchor LEFT JOIN rh ON rh.qid = q.turn LEFT JOIN sto h ON h.turn = rh.hit GROUP BY 1)"""


@query("x5_eval", f"{_eval_sql()} SELECT qid, found, n, round(precision, 6) AS precision, cross_room, cross_thread, cross_actor, n = 0 AS empty FROM evl")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).withColumn("precision", F.round("precision", 6))


@query("x6_report", f"{_eval_sql()} SELECT count(*) AS queries, round(avg(found::INT), 6) AS hit_rate, round(avg((n = 0)::INT), 6) AS empty_rate, round(avg(precision), 6) AS avg_precision, round(avg(cross_room::INT), 6) AS cross_room_rate, round(avg(cross_thread::INT), 6) AS cross_thread_rate, round(avg(cross_actor::INT), 6) AS cross_actor_rate FROM evl")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)
    rate = lambda c, name: F.round(F.avg(F.col(c).cast("int")), 6).alias(name)
    return e.agg(F.count("*").alias("queries"), rate("found", "hit_rate"), rate("empty", "empty_rate"), F.round(F.avg("precision"), 6).alias("avg_precision"), *[rate(c, f"{c}_rate") for c in ("cross_room", "cross_thread", "cross_actor")])


def simulate(spark: SparkSession, turns_n: int = 240, seed: int = 42) -> DataFrame:
    """The rates of one run over a scenario: statements of the first three fifths are stored, queries of the rest ask."""
    from .retrieval import Store, rank_memories, rank_turns

    s = scenario(spark, turns_n, seed=seed)
    scope, own = F.concat(F.lit("sim:"), "room_id"), F.col("mode").startswith("personal")
    m = s.select(
        F.col("turn").alias("mem_id"), scope.alias("scope_key"), F.concat(F.lit("sim/"), "user_id").alias("actor_key"), F.concat(scope, F.lit("$th:"), F.col("topic_id") + 1).alias("thread_key"), F.when(own, "actor").otherwise("scope").alias("memory_scope"),
        F.concat(scope, F.lit("|S:"), F.col("topic_id") + 1).alias("anchor"), F.lit(1).cast("long").alias("cluster_id"), F.array("turn").alias("turns"), F.concat_ws(" ", "room_id", "user_id", F.col("topic_id").cast("string")).alias("text"), "vec", F.col("topic_id").alias("topic"), "turn", "mode",
    )
    cut = turns_n * 3 // 5
    store = Store(m.where(f"turn <= {cut} and mode like '%statement'").drop("mode"), m.where(f"turn > {cut} and mode like '%query'").drop("mode"))
    e = evaluate(rank_turns(rank_memories(store.recalled()), store.mem), truth(store.ask, store.mem), store.mem)
    return e.agg(F.lit(seed).alias("seed"), F.count("*").alias("queries"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("found", "empty", "precision", "cross_room", "cross_thread", "cross_actor")])


def report(runs: list[DataFrame]) -> DataFrame:
    """The runs, and their mean in a row without a seed."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.unionByName(every.agg(F.lit(None).cast("int").alias("seed"), F.sum("queries").alias("queries"), *[F.avg(c).alias(c) for c in every.columns[2:]]))


@query("x6_memory_stats", f"{_M} SELECT memory_scope, count(*) AS n, count(DISTINCT scope_key) AS scopes, count(DISTINCT actor_key) AS actors FROM mem GROUP BY 1")
def x6_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(turns(spark, sf_dir)).groupBy("memory_scope").agg(F.count("*").alias("n"), F.countDistinct("scope_key").alias("scopes"), F.countDistinct("actor_key").alias("actors"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


@query("u1_scalars", "SELECT event_id, round(least(50.0, greatest(1.0, value)), 6)::DOUBLE AS held, coalesce(try_cast(event_type AS DOUBLE), 0)::DOUBLE AS number FROM events")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(clamp(F.col("value"), 1.0, 50.0), 6).alias("held"), F.coalesce(F.col("event_type").try_cast("double"), F.lit(0.0)).alias("number"))
