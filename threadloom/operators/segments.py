"""Topic segmentation of an ordered vector stream, fingerprints and chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT, Topic
from ..plans.fold import keyed_fold
from ..sources.fixtures import MEMORIES, NODES, TURNS, cosine, memories, topic_nodes, turns
from .text import compress
from .vectors import mean_vectors

_T = f"WITH {TURNS}"
_M = f"{_T}, {MEMORIES}"


@query("s1_adjacent", f"{_T} SELECT turn, room_id, round(coalesce(list_cosine_similarity(lag(vec) OVER (PARTITION BY room_id ORDER BY turn), vec), 0), 6) AS sim FROM turns")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("vec").over(Window.partitionBy("room_id").orderBy("turn"))
    return turns(spark, sf_dir).select("turn", "room_id", F.round(cosine(before, F.col("vec")), 6).alias("sim"))


def direction(v: np.ndarray) -> np.ndarray:
    """The vector at length one; a zero vector stays as it is."""
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 else v


def py_cosine(a, b) -> float:
    if a is None or b is None or not len(a) or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    n = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / n if n > 0 else 0.0


def sql_mean(vectors: str) -> str:
    """SQL for the mean of a list of vectors."""
    return f"list_transform(range(1, 65), lambda i: list_sum(list_transform({vectors}, lambda v: v[i])) / len({vectors}))"


class Segment:
    """The open topic of one stream: what is needed to test the next vector."""

    def __init__(self, _key: object = None):
        self.start, self.scope, self.n, self.first, self.head, self.tail, self.last, self.turn = None, None, 0, [], None, [], None, None

    def restart(self, turn: int, scope: str, vec: np.ndarray) -> None:
        self.__init__()
        self.start, self.scope = turn, scope
        self.add(turn, vec)

    def add(self, turn: int, vec: np.ndarray) -> None:
        self.n += 1
        self.turn = turn
        if self.head is None and len(vec):
            self.first.append(vec)


def segment_step(cfg: Topic):
    """Whether a turn starts a topic.

    The vector joins head and tail before the test, so the one that completes
    the head is compared with it; a split takes it out of the old topic.
    """

    def step(s: Segment, row: dict) -> list[tuple]:
        turn, vec, scope = row["turn"], np.asarray(row["vec"], np.float64), row["scope_key"]
        if s.start is None or scope != s.scope:
            why = "first" if s.start is None else "scope"
            s.restart(turn, scope, vec)
            s.tail, s.last = [vec], vec
            return [(turn, scope, s.start, True, why)]
        first = [*s.first, vec] if s.head is None else s.first
        head = s.head if s.head is not None else (np.mean(first[: cfg.head], axis=0) if len(first) >= cfg.head else None)
        tail = [*s.tail, vec][-cfg.tail :]
        split = ""
        if head is not None:
            if py_cosine(s.last, vec) < cfg.break_at and py_cosine(head, vec) < cfg.confirm:
                split = "break"
            elif len(tail) >= cfg.tail and py_cosine(head, np.mean(tail, axis=0)) < cfg.drift:
                split = "drift"
        if split and s.n >= cfg.min_length:
            s.restart(turn, scope, vec)
            s.tail, s.last = [vec], vec
            return [(turn, scope, s.start, True, split)]
        s.n, s.turn, s.head, s.tail, s.first = s.n + 1, turn, head, tail, [] if head is not None else first
        if not split:
            s.last = vec
        return [(turn, scope, s.start, False, "")]

    return step


def segments(t: DataFrame, cfg: Topic = DEFAULT.topic, per_scope: bool = True) -> DataFrame:
    """turn, scope_key, start_turn, is_split, reason.

    One stream per scope by default; ``per_scope=False`` folds all turns as one
    interleaved stream, in which a change of scope closes the topic.
    """
    t = t.select("turn", F.concat_ws(":", "source", "room_id").alias("scope_key"), "vec")
    t = t.withColumn("stream", F.col("scope_key") if per_scope else F.lit("all"))
    return keyed_fold(t, "stream", ["turn"], Segment, segment_step(cfg), "turn long, scope_key string, start_turn long, is_split boolean, reason string")


_COS = "list_cosine_similarity"
# The step as a recursive query; the mean of an unfinished head is carried along and counts once it is known.
_SEG = f"""sx AS (SELECT turn, source || ':' || room_id AS scope_key, vec, row_number() OVER (PARTITION BY room_id ORDER BY turn) AS n FROM turns),
seg AS MATERIALIZED (WITH RECURSIVE f AS (
  SELECT scope_key, n, turn, turn AS start_turn, true AS is_split, 'first' AS reason, 1 AS size, [vec] AS early, vec AS head, false AS known, [vec] AS tail, vec AS prev FROM sx WHERE n = 1
  UNION ALL
  SELECT scope_key, n, turn, CASE WHEN cut THEN turn ELSE start_turn END, cut, CASE WHEN cut THEN why ELSE '' END, CASE WHEN cut THEN 1 ELSE size + 1 END,
    CASE WHEN cut THEN [vec] ELSE early END, head, known AND NOT cut, CASE WHEN cut THEN [vec] ELSE tail END, CASE WHEN cut OR why = '' THEN vec ELSE prev END
  FROM (SELECT *, why <> '' AND size >= 2 AS cut FROM (
    SELECT *, CASE WHEN NOT known THEN '' WHEN pc < 0.48 AND hc < 0.55 THEN 'break' WHEN len(tail) >= 3 AND tc < 0.62 THEN 'drift' ELSE '' END AS why FROM (
     SELECT *, {_COS}(prev, vec) AS pc, {_COS}(head, vec) AS hc, {_COS}(head, tm) AS tc FROM (
      SELECT * EXCLUDE (head, known, hm), CASE WHEN known THEN head ELSE hm END AS head, known OR len(early) >= 4 AS known FROM (
       SELECT *, {sql_mean('early')} AS hm, {sql_mean('tail')} AS tm FROM (
        SELECT f.scope_key, x.n, x.turn, x.vec, start_turn, size, prev, head, known, list_append(early, x.vec)[:4] AS early, list_append(tail, x.vec)[-3:] AS tail
        FROM f JOIN sx x ON x.scope_key = f.scope_key AND x.n = f.n + 1)))))))
  SELECT turn, scope_key, start_turn, is_split, reason FROM f)"""


@query("s2_segments", f"{_T}, {_SEG} SELECT turn, scope_key, start_turn, is_split, reason FROM seg")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(turns(spark, sf_dir))


@query("s3_scope_boundary", f"{_T}, o AS (SELECT turn, source || ':' || room_id AS scope_key, lag(source || ':' || room_id) OVER (ORDER BY turn) AS prev FROM turns) SELECT turn, scope_key FROM o WHERE prev IS NULL OR prev <> scope_key")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the interleaved stream at which the scope changes; each starts a topic there."""
    s = segments(turns(spark, sf_dir), per_scope=False)
    return s.where("reason in ('first', 'scope')").select("turn", "scope_key")


def closed(t: DataFrame, seg: DataFrame) -> DataFrame:
    """scope_key, start_turn, end_turn, n_turns, centroid of each segment; the last of a scope has no end."""
    j = t.select("turn", "vec").join(seg.select("turn", "scope_key", "start_turn"), "turn")
    j = j.withColumn("seg", F.concat_ws("|", "scope_key", F.col("start_turn").cast("string")))
    by = j.groupBy("seg", "scope_key", "start_turn").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"))
    by = by.join(mean_vectors(j, "seg", "vec").withColumnRenamed("m", "centroid"), "seg")
    later = F.lead("start_turn").over(Window.partitionBy("scope_key").orderBy("start_turn"))
    return by.withColumn("end_turn", F.when(later.isNotNull(), F.col("last_turn"))).drop("seg")


_CLOSED = """cl0 AS (SELECT scope_key, start_turn, max(turn) AS last_turn, count(*) AS n_turns FROM seg GROUP BY ALL), clp AS (SELECT s.scope_key, s.start_turn, p, avg(t.vec[p]) AS x FROM seg s JOIN turns t USING (turn), range(1, 65) r(p) GROUP BY ALL),
clc AS (SELECT scope_key, start_turn, list(x ORDER BY p) AS centroid FROM clp GROUP BY ALL), cl AS (SELECT *, CASE WHEN lead(start_turn) OVER (PARTITION BY scope_key ORDER BY start_turn) IS NOT NULL THEN last_turn END AS end_turn FROM cl0 JOIN clc USING (scope_key, start_turn))"""


@query("s4_closed_segments", f"{_T}, {_SEG}, {_CLOSED} SELECT scope_key, start_turn, end_turn, n_turns FROM cl")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its first and last turn; the open one of a scope has no end."""
    t = turns(spark, sf_dir)
    return closed(t, segments(t)).select("scope_key", "start_turn", "end_turn", "n_turns")


def anchors(seg: DataFrame) -> DataFrame:
    """turn, stable anchor S:<start>, live anchor (A: while open) and closed ordinal C:<n>."""
    w = Window.partitionBy("scope_key").orderBy("turn")
    s = seg.withColumn("ordinal", F.sum(F.col("is_split").cast("int")).over(w))
    last = F.max("ordinal").over(Window.partitionBy("scope_key"))
    live = F.when(F.col("ordinal") == last, F.concat(F.lit("A:"), "start_turn")).otherwise(F.concat(F.lit("C:"), "ordinal"))
    return s.select("turn", "scope_key", F.concat(F.lit("S:"), "start_turn").alias("stable"), live.alias("live"))


@query("s5_turn_segment", f"{_T}, s AS (SELECT room_id, conv_turn AS k, min(turn) AS start FROM turns GROUP BY ALL), r AS (SELECT room_id, start, lead(start) OVER (PARTITION BY room_id ORDER BY start) AS nxt FROM s) SELECT t.turn, r.start AS start_turn FROM turns t JOIN r ON r.room_id = t.room_id AND t.turn >= r.start AND (r.nxt IS NULL OR t.turn < r.nxt)")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of turns in the spans [start, end]: the latest start at or before each turn, by one window instead of a range join."""
    t = turns(spark, sf_dir)
    spans = t.groupBy("room_id", F.col("conv_turn").alias("k")).agg(F.min("turn").alias("turn")).select("room_id", "turn", F.col("turn").alias("start"))
    both = t.select("room_id", "turn", F.lit(None).cast("long").alias("start"), F.lit(1).alias("is_turn")).unionByName(spans.withColumn("is_turn", F.lit(0)))
    at = F.last("start", ignorenulls=True).over(Window.partitionBy("room_id").orderBy("turn", "is_turn"))
    return both.withColumn("start_turn", at).where("is_turn = 1").select("turn", "start_turn")


@query("s5_anchors", f"{_T}, {_SEG}, o AS (SELECT *, sum(is_split::INT) OVER (PARTITION BY scope_key ORDER BY turn) AS k FROM seg), l AS (SELECT *, max(k) OVER (PARTITION BY scope_key) AS m FROM o) SELECT turn, scope_key, 'S:' || start_turn AS stable, CASE WHEN k = m THEN 'A:' || start_turn ELSE 'C:' || k END AS live FROM l")
def s5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(segments(turns(spark, sf_dir)))


def fingerprints(mem: DataFrame, top: int = 3) -> DataFrame:
    """anchor, cluster_id, rank, weight: the clusters that most of a topic's memories fall into."""
    by = mem.groupBy("anchor", "cluster_id").agg(F.count("*").alias("hits"))
    by = by.withColumn("weight", F.col("hits") / F.sum("hits").over(Window.partitionBy("anchor")))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("hits").desc(), "cluster_id"))
    return by.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("anchor", "cluster_id", "rank", "weight")


_FP = "h AS (SELECT anchor, cluster_id, count(*) AS hits FROM mem GROUP BY ALL), fp0 AS (SELECT *, hits / sum(hits) OVER (PARTITION BY anchor) AS weight, row_number() OVER (PARTITION BY anchor ORDER BY hits DESC, cluster_id) AS rank FROM h), fp AS (SELECT anchor, cluster_id, rank, weight FROM fp0 WHERE rank <= 3)"


@query("s6_fingerprint", f"{_M}, {_FP} SELECT anchor, cluster_id, rank, round(weight, 6) AS weight FROM fp")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(memories(turns(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


def chains(nodes: DataFrame, fp: DataFrame, cfg: Topic = DEFAULT.topic) -> DataFrame:
    """anchor, other, score: like topics of the same scope, by centroid, shared clusters and dominant cluster."""
    n = nodes.select("scope_key", "anchor", "centroid")
    o = nodes.select("scope_key", F.col("anchor").alias("other"), F.col("centroid").alias("oc"))
    pairs = n.join(o, "scope_key").where("anchor <> other")
    g = fp.select(F.col("anchor").alias("other"), "cluster_id", F.col("weight").alias("ow"), F.col("rank").alias("orank"))
    # only anchors of one scope can meet, so the overlap is joined to their pairs
    over = pairs.select("anchor", "other").join(fp, "anchor").join(g, ["other", "cluster_id"])
    over = over.groupBy("anchor", "other").agg(F.sum(F.least("weight", "ow")).alias("shared"), F.max((F.col("rank") == 1) & (F.col("orank") == 1)).alias("same"))
    j = pairs.join(over, ["anchor", "other"], "left")
    score = 0.55 * F.greatest(F.lit(0.0), cosine(F.col("centroid"), F.col("oc"))) + 0.45 * F.coalesce("shared", F.lit(0.0)) + F.when(F.col("same"), 0.05).otherwise(0.0)
    j = j.withColumn("score", score).where(F.col("score") >= cfg.chain_min)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.round("score", 9).desc(), "other"))
    return j.withColumn("rank", rank.cast("long")).where(F.col("rank") <= cfg.chain_top).select("anchor", "other", "rank", "score")


@query("s7_chain", f"{_M}, {NODES}, {_FP}, ov AS (SELECT a.anchor, b.anchor AS other, sum(least(a.weight, b.weight)) AS shared, bool_or(a.rank = 1 AND b.rank = 1) AS same FROM fp a JOIN fp b USING (cluster_id) GROUP BY ALL), sc AS (SELECT a.anchor, b.anchor AS other, 0.55 * greatest(0, list_cosine_similarity(a.centroid, b.centroid)) + 0.45 * coalesce(shared, 0) + CASE WHEN same THEN 0.05 ELSE 0 END AS score FROM nodes a JOIN nodes b ON a.scope_key = b.scope_key AND a.anchor <> b.anchor LEFT JOIN ov ON ov.anchor = a.anchor AND ov.other = b.anchor), r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, other) AS rank FROM sc WHERE score >= 0.2) SELECT anchor, other, rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = memories(turns(spark, sf_dir))
    return chains(topic_nodes(mem), fingerprints(mem)).withColumn("score", F.round("score", 6))


def summary_variants(full: Column) -> dict[str, Column]:
    """A summary at its three lengths and none."""
    return {"full": full, "slight": compress(full, 0.65), "heavy": compress(full, 0.30), "none": F.lit("")}


def _short(share: float) -> str:
    most = f"floor(length(text) * {share})::INT"
    return f"CASE WHEN length(text) <= {most} THEN text WHEN {most} - floor({most} * 0.6)::INT - 3 < 10 THEN substr(text, 1, {most}) || '...' ELSE substr(text, 1, floor({most} * 0.6)::INT) || '...' || right(text, {most} - floor({most} * 0.6)::INT - 3) END"


@query("s8_summaries", f"{_T}, f AS (SELECT room_id, topic, string_agg(user_input, chr(10) ORDER BY turn) AS text FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY room_id, topic ORDER BY turn) <= 5) GROUP BY ALL) SELECT room_id, topic, text AS \"full\", {_short(0.65)} AS slight, {_short(0.30)} AS heavy, '' AS \"none\" FROM f")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summariser would be given, its first five turns, and the shorter variants; the summariser itself is a plug-in and off."""
    n = F.row_number().over(Window.partitionBy("room_id", "topic").orderBy("turn"))
    t = turns(spark, sf_dir).withColumn("n", n).where("n <= 5")
    full = t.groupBy("room_id", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "user_input"))), lambda s: s["user_input"]), "\n").alias("full"))
    return full.select("room_id", "topic", *[c.alias(k) for k, c in summary_variants(F.col("full")).items()])


def rounded(c: Column, places: int) -> Column:
    """Half away from zero; a negative number that rounds to zero keeps its sign, as in the SQL."""
    return F.round(F.abs(c), places) * F.signum(c)


@query("s9_segment_table", f"{_T}, {_SEG}, {_CLOSED} SELECT scope_key, start_turn, end_turn, n_turns, list_transform(centroid, lambda x: round(x, 5)) AS centroid FROM cl")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment table as it is stored."""
    t = turns(spark, sf_dir)
    return closed(t, segments(t)).select("scope_key", "start_turn", "end_turn", "n_turns", F.transform("centroid", lambda x: rounded(x, 5)).alias("centroid"))
