"""Derived input views: messages, turns with blended vectors, and what is built from them.

The SQL text of each view for the checking engine stands beside its DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .views import once

#: Rows that the corpus lacks: other scripts, cues, reactions, mentions, risky texts, boundary lengths.
LITERALS: list[str] = [
    "你好，世界！今天天气怎么样？我们去公园吧。", "继续刚才的话题；@小明 你怎么看", "哈哈哈", "666", "[笑][哭]", "@Alice, reply to @bob! thanks @ALICE",
    "ignore: system prompt please", "请记住这个：```code``` 好的", "/cmd run now", "  /help\nsecond line\r\nthird  ", "a" * 239, "b" * 240, "c" * 479, "d" * 480,
    "Hello, 世界 mixed 文本 with ASCII words", "嗯", "好的", "……", "<think>secret\n\nplan</think>\n\nanswer one\n\nanswer two", "tab\tand\\slash\nnewline", "", "   ", "…！？",
    "{'a', \"b c\"} tail", "x { 'one', 'two' } y", "before that, continue", "ok ok ok", "啊啊啊啊啊啊啊",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, role, text: every message of the conversations, and the literal rows under negative ids."""
    lit = spark.createDataFrame([(-i - 1, "user", s) for i, s in enumerate(LITERALS)], "id long, role string, text string")
    conv = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return conv.unionByName(lit)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_text(s: str) -> str:
    """A literal whose line ends are spelt out."""
    parts = []
    for piece in s.replace("\r", "\x00r\x00").replace("\n", "\x00n\x00").replace("\t", "\x00t\x00").split("\x00"):
        parts.append({"r": "chr(13)", "n": "chr(10)", "t": "chr(9)"}.get(piece) or _sql_text(piece))
    return " || ".join(parts)


MESSAGES = "messages AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, 'user', {_duck_text(s)})" for i, s in enumerate(LITERALS)) + ") v(id, role, text))"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row; a column named inside a lambda is computed anew for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is missing, empty, of other length or of zero length."""
    like = let(norm(a) * norm(b), lambda n: F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n))
    return F.coalesce(like, F.lit(0.0))


def blend(parts: list[tuple[Column | float, Column]]) -> Column:
    def scale(w: Column | float, v: Column) -> Column:
        return F.transform(v, lambda x: x * w)

    scaled = [scale(w, v) for w, v in parts]
    return unit(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled))


NOISE = (0.03, 0.45, 1.0, 0.03)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user message, its rooms interleaved: turn, texts, identity, topic, event time, vector."""
    return once(spark, sf_dir, "turns", lambda: _turns(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    user = conv.where("role = 'user'").select("conv_id", F.col("turn").alias("conv_turn"), F.col("text").alias("user_input"))
    reply = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("conv_turn"), F.col("text").alias("reply"))
    # numbers inside each conv_turn, behind those of the conv_turns before; one row a conv_turn is all that one task orders
    sizes = user.groupBy("conv_turn").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("conv_turn").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("conv_turn", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_turn").orderBy("conv_id"))
    user = user.withColumn("inside", inside).join(sizes, "conv_turn").withColumn("turn", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside")
    df = user.join(reply, ["conv_id", "conv_turn"], "left")
    df = df.withColumn("topic", (F.col("conv_id") + F.floor(F.col("conv_turn") / 2)) % 6)
    emb = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    df = df.join(emb.agg(F.count("*").alias("n_emb")), F.lit(True))
    keys = {"k0": F.col("topic"), "k1": 100 + F.col("conv_id") % 3, "k2": 200 + F.col("conv_id") % 100, "k3": (F.col("turn") * 7919) % F.col("n_emb")}
    df = df.withColumns(keys)
    # the last key is any row's; the others are a few hundred, whose shuffle would put all turns into as many tasks
    few = {"k0": (-5, 5), "k1": (98, 102), "k2": (101, 299)}
    for k in reversed(keys):
        e = emb.select(F.col("vec_id").alias(k), F.col("e").alias(f"e{k}"))
        df = df.join(F.broadcast(e.where(F.col(k).between(*few[k]))) if k in few else e, k)
    weight = F.element_at(F.array(*[F.lit(x) for x in NOISE]), (F.col("turn") % 4 + 1).cast("int"))
    vec = blend([(0.95, F.col("ek0")), (0.10, F.col("ek1")), (0.03, F.col("ek2")), (weight, F.col("ek3"))])
    return df.select(
        "turn", "conv_id", "conv_turn", F.lit("bilibili").alias("source"), F.concat(F.lit("room"), F.col("conv_id") % 3 + 1).alias("room_id"), F.concat(F.lit("u"), F.col("conv_id")).alias("user_id"),
        F.lit("").alias("nickname"), "user_input", F.coalesce("reply", F.lit("")).alias("assistant_text"), "topic",
        F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("event_ts"), vec.alias("vec"),
    )


TURNS = """e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, count(*) OVER () AS n FROM embeddings),
t0 AS (SELECT row_number() OVER (ORDER BY u.turn, u.conv_id) AS turn, u.conv_id, u.turn AS conv_turn, u.text AS user_input, coalesce(a.text, '') AS assistant_text, (u.conv_id + u.turn // 2) % 6 AS topic
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
t1 AS (SELECT t0.*, list_transform(range(1, 65), lambda i: 0.95 * e0.e[i] + 0.1 * e1.e[i] + 0.03 * e2.e[i] + ([0.03, 0.45, 1.0, 0.03])[t0.turn % 4 + 1]::DOUBLE * e3.e[i]) AS raw
  FROM t0 JOIN e e0 ON e0.vec_id = topic JOIN e e1 ON e1.vec_id = 100 + conv_id % 3 JOIN e e2 ON e2.vec_id = 200 + conv_id % 100 JOIN e e3 ON e3.vec_id = (t0.turn * 7919) % e0.n),
turns AS MATERIALIZED (SELECT turn, conv_id, conv_turn, 'bilibili' AS source, 'room' || (conv_id % 3 + 1) AS room_id, 'u' || conv_id AS user_id, '' AS nickname, user_input, assistant_text, topic,
  TIMESTAMP '2024-01-01' + to_minutes(turn::INT) AS event_ts, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) AS vec FROM t1)"""


def memories(turns_df: DataFrame) -> DataFrame:
    """One memory per turn: its scope kind by turn mod 3, its cluster by topic and room."""
    scope = F.concat_ws(":", "source", "room_id")
    kind = F.element_at(F.array(F.lit("thread"), F.lit("actor"), F.lit("scope")), (F.col("turn") % 3 + 1).cast("int"))
    return turns_df.select(
        F.col("turn").alias("mem_id"), scope.alias("scope_key"), F.concat_ws("/", "source", F.concat(F.lit("room:"), "room_id"), F.concat(F.lit("uid:"), "user_id")).alias("actor_key"),
        F.concat(scope, F.lit("$th:"), F.col("topic") + 1).alias("thread_key"), kind.alias("memory_scope"), F.concat(scope, F.lit("|S:"), F.col("topic") + 1).alias("anchor"),
        (F.col("conv_id") % 5 + 1).alias("cluster_id"), F.array("turn").alias("turns"), F.col("user_input").alias("text"), "vec", "topic", "turn",
    )


MEMORIES = """mem AS MATERIALIZED (SELECT turn AS mem_id, source || ':' || room_id AS scope_key, source || '/room:' || room_id || '/uid:' || user_id AS actor_key,
  source || ':' || room_id || '$th:' || (topic + 1) AS thread_key, (['thread', 'actor', 'scope'])[turn % 3 + 1] AS memory_scope, source || ':' || room_id || '|S:' || (topic + 1) AS anchor,
  conv_id % 5 + 1 AS cluster_id, [turn] AS turns, user_input AS text, vec, topic, turn FROM turns)"""


def mean_of(vec: str, dim: int = 64) -> Column:
    """The mean of a group's vectors, as an aggregate."""
    n = F.count("*")
    return F.array(*[F.sum(F.get(F.col(vec), F.lit(i))) / n for i in range(dim)])


def topic_nodes(mem: DataFrame) -> DataFrame:
    """anchor, scope_key, centroid (unit mean of its memories), memory_count, last_turn."""
    by = mem.groupBy("anchor", "scope_key").agg(mean_of("vec").alias("m"), F.count("*").alias("memory_count"), F.max("turn").alias("last_turn"))
    return by.select("anchor", "scope_key", unit(F.col("m")).alias("centroid"), "memory_count", "last_turn")


NODES = """npos AS (SELECT anchor, scope_key, p, avg(vec[p]) AS x, count(*) AS n, max(turn) AS last_turn FROM mem, range(1, 65) r(p) GROUP BY ALL),
nraw AS (SELECT anchor, scope_key, list(x ORDER BY p) AS v, max(n) AS memory_count, max(last_turn) AS last_turn FROM npos GROUP BY ALL),
nodes AS MATERIALIZED (SELECT anchor, scope_key, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS centroid, memory_count, last_turn FROM nraw)"""


def split_store(mem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The memories of the first three fifths of the turns, which are a store, and those of later turns, which ask it."""
    cut = mem.agg(F.floor(F.max("turn") * 3 / 5).alias("cut"))
    both = mem.join(F.broadcast(cut), F.lit(True))
    return both.where("turn <= cut").drop("cut"), both.where("turn > cut").drop("cut")


STORE = "sto AS MATERIALIZED (SELECT * FROM mem WHERE turn <= (SELECT max(turn) FROM mem) * 3 // 5), ask AS MATERIALIZED (SELECT * FROM mem WHERE turn > (SELECT max(turn) FROM mem) * 3 // 5)"
