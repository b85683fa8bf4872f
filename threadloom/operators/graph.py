"""Learning between topics: edges, decay, feedback, activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT, Activation, Graph
from ..plans.fold import keyed_fold
from ..sources.fixtures import MEMORIES, NODES, TURNS, cosine, memories, topic_nodes, turns
from .memory import prune

_M = f"WITH {TURNS}, {MEMORIES}"
_NOW = "(SELECT max(turn) FROM mem)"


def _mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(turns(spark, sf_dir))


def _with_now(df: DataFrame, mem: DataFrame) -> DataFrame:
    """Rows with the last turn of the memories as ``now``: one row joined in, nothing on the driver."""
    return df.join(F.broadcast(mem.agg(F.max("turn").alias("now"))), F.lit(True))


def transitions(mem: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """src, dst, kind, amount, turn: one event whenever the topic of a scope changes."""
    prev = F.lag("anchor").over(Window.partitionBy("scope_key").orderBy("turn"))
    t = mem.select("scope_key", "turn", F.col("anchor").alias("dst"), prev.alias("src")).where("src is not null and src <> dst")
    return t.select("src", "dst", F.lit("transition").alias("kind"), F.lit(cfg.transition).alias("amount"), "turn")


_TR = "tr AS MATERIALIZED (SELECT * FROM (SELECT turn, anchor AS dst, lag(anchor) OVER (PARTITION BY scope_key ORDER BY turn) AS src FROM mem) WHERE src IS NOT NULL AND src <> dst)"


@query("e1_transitions", f"{_M}, {_TR} SELECT src, dst, round(sum(0.12), 6)::DOUBLE AS weight, count(*) AS support, max(turn) AS last_turn FROM tr GROUP BY ALL")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transitions(_mem(spark, sf_dir))
    return t.groupBy("src", "dst").agg(F.round(F.sum("amount"), 6).alias("weight"), F.count("*").alias("support"), F.max("turn").alias("last_turn"))


def edges(events: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """src, dst with the weight of each kind held in [0, cap], support and last turn."""
    kinds = {k: F.greatest(F.lit(0.0), F.least(F.lit(cfg.edge_cap), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0)))).alias(k) for k in ("transition", "recall", "adopt")}
    return events.groupBy("src", "dst").agg(*kinds.values(), F.count("*").alias("support"), F.max("turn").alias("last_turn"))


def edge_events(mem: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """Transitions, and for every one of them a recall or an adoption by its turn."""
    t = transitions(mem, cfg)
    more = t.select("src", "dst", F.when(F.col("turn") % 3 == 0, "adopt").otherwise("recall").alias("kind"), F.when(F.col("turn") % 3 == 0, cfg.adopt).otherwise(cfg.recall).alias("amount"), "turn")
    return t.unionByName(more)


_EV = f"{_TR}, ev AS (SELECT src, dst, turn, 'transition' AS kind, 0.12::DOUBLE AS amount FROM tr UNION ALL SELECT src, dst, turn, CASE WHEN turn % 3 = 0 THEN 'adopt' ELSE 'recall' END, CASE WHEN turn % 3 = 0 THEN 0.18 ELSE 0.1 END FROM tr), ed AS MATERIALIZED (SELECT src, dst, {', '.join(f'''greatest(0.0, least(8.0, coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0)))::DOUBLE AS {k}''' for k in ('transition', 'recall', 'adopt'))}, count(*) AS support, max(turn) AS last_turn FROM ev GROUP BY ALL)"


@query("e2_edges", f"{_M}, {_EV} SELECT src, dst, round(transition, 6) AS transition, round(recall, 6) AS recall, round(adopt, 6) AS adopt, support, last_turn FROM ed")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(edge_events(_mem(spark, sf_dir))).withColumns({k: F.round(k, 6) for k in ("transition", "recall", "adopt")})


def decayed(events: DataFrame, now: Column, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """src, dst, weight: amounts decayed to the turn ``now``, entries that have faded dropped."""
    w = F.sum(F.col("amount") * F.pow(F.lit(cfg.decay), now - F.col("turn")))
    return events.groupBy("src", "dst").agg(w.alias("weight")).where(F.col("weight") >= cfg.prune_below)


@query("e3_decay", f"{_M}, {_EV} SELECT src, dst, round(sum(amount * pow(0.995, {_NOW} - turn)), 6) AS weight FROM ev GROUP BY ALL HAVING sum(amount * pow(0.995, {_NOW} - turn)) >= 1e-4")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _mem(spark, sf_dir)
    return decayed(_with_now(edge_events(mem), mem), F.col("now")).select("src", "dst", F.round("weight", 6).alias("weight"))


def visible_sql(m: str, q: str) -> str:
    return f"({m}.memory_scope = 'scope' OR ({m}.memory_scope = 'thread' AND {m}.thread_key = {q}.thread_key) OR ({m}.memory_scope = 'actor' AND {m}.actor_key = {q}.actor_key))"


def recall_log(mem: DataFrame, back: int = 16, k: int = 3) -> DataFrame:
    """flow_key, turn, anchor, retrieved, adopted: what each turn recalled and then wrote.

    Recalled are the ``k`` nearest visible memories among the last ``back`` of
    its own topic, a frame of bounded size; adopted is the memory of the turn.
    """
    w = Window.partitionBy("anchor").orderBy("turn").rowsBetween(-back, -1)
    seen = F.collect_list(F.struct("mem_id", "vec", "memory_scope", "thread_key", "actor_key")).over(w)
    q = mem.select("scope_key", "turn", "anchor", "mem_id", "vec", "thread_key", "actor_key", seen.alias("seen"))
    m = q.select("turn", "vec", "thread_key", "actor_key", F.explode("seen").alias("m"))
    kind = F.col("m.memory_scope")
    ok = (kind == "scope") | ((kind == "thread") & (F.col("m.thread_key") == F.col("thread_key"))) | ((kind == "actor") & (F.col("m.actor_key") == F.col("actor_key")))
    near = m.where(ok).select("turn", F.struct((-F.round(cosine(F.col("vec"), F.col("m.vec")), 9)).alias("o"), F.col("m.mem_id").alias("id")).alias("x"))
    got = near.groupBy("turn").agg(F.array_sort(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, k), lambda x: x["id"])).alias("retrieved"))
    out = q.select(F.col("scope_key").alias("flow_key"), "turn", "anchor", F.array("mem_id").alias("adopted")).join(got, "turn", "left")
    return out.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<long>")))


def log_sql(mem: str) -> str:
    return f"""lo AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS ln FROM {mem}),
lg AS MATERIALIZED (SELECT q.scope_key AS flow_key, q.turn, q.anchor, coalesce(l.retrieved, []) AS retrieved, [q.mem_id] AS adopted FROM lo q LEFT JOIN (SELECT turn, list(mem_id ORDER BY mem_id) AS retrieved FROM (SELECT q.turn, m.mem_id FROM lo q JOIN lo m ON m.anchor = q.anchor AND m.ln BETWEEN q.ln - 16 AND q.ln - 1 AND {visible_sql('m', 'q')}
  QUALIFY row_number() OVER (PARTITION BY q.turn ORDER BY round(list_cosine_similarity(q.vec, m.vec), 9) DESC, m.mem_id) <= 3) GROUP BY 1) l ON l.turn = q.turn)"""


_LG = log_sql("mem")


@query("e4_priors", f"{_M}, {_LG}, p AS (SELECT anchor, mem_id, sum(a)::DOUBLE AS weight FROM (SELECT anchor, unnest(retrieved) AS mem_id, 0.1 AS a FROM lg UNION ALL SELECT anchor, unnest(adopted), 0.18 FROM lg) GROUP BY ALL) SELECT anchor, mem_id, round(weight, 6) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY round(weight, 9) DESC, mem_id) <= 64")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved and adopted memories raise their topic's prior."""
    g = recall_log(_mem(spark, sf_dir))
    each = g.select("anchor", F.explode("retrieved").alias("mem_id"), F.lit(DEFAULT.graph.recall).alias("a")).unionByName(g.select("anchor", F.explode("adopted").alias("mem_id"), F.lit(DEFAULT.graph.adopt).alias("a")))
    p = each.groupBy("anchor", "mem_id").agg(F.sum("a").alias("weight"))
    return prune(p, "anchor", "mem_id", DEFAULT.graph.prior_cap).select("anchor", "mem_id", F.round("weight", 6).alias("weight"))


def successors(log: DataFrame, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """flow_key, src, dst, w: what was retrieved or adopted after what was selected at the flow's turn before."""
    w = Window.partitionBy("flow_key").orderBy("turn")
    r = log.withColumn("prev", F.lag(F.array_union("retrieved", "adopted")).over(w)).where("prev is not null")
    r = r.select("flow_key", F.explode("prev").alias("src"), "retrieved", "adopted")
    pairs = r.select("flow_key", "src", F.explode("retrieved").alias("dst"), F.lit(cfg.recall).alias("a")).unionByName(r.select("flow_key", "src", F.explode("adopted").alias("dst"), F.lit(cfg.adopt).alias("a")))
    by = pairs.where("src <> dst").groupBy("flow_key", "src", "dst").agg(F.sum("a").alias("w"))
    n = F.row_number().over(Window.partitionBy("flow_key", "src").orderBy(F.round("w", 9).desc(), "dst"))
    return by.withColumn("n", n).where(F.col("n") <= cfg.next_cap).drop("n")


_SU = """sp AS (SELECT flow_key, retrieved, adopted, unnest(prev) AS src FROM (SELECT *, lag(list_concat(retrieved, adopted)) OVER (PARTITION BY flow_key ORDER BY turn) AS prev FROM lg) WHERE prev IS NOT NULL),
su0 AS (SELECT flow_key, src, dst, sum(a)::DOUBLE AS w FROM (SELECT flow_key, src, unnest(retrieved) AS dst, 0.1 AS a FROM sp UNION ALL SELECT flow_key, src, unnest(adopted), 0.18 FROM sp) WHERE src <> dst GROUP BY ALL), su AS MATERIALIZED (SELECT * FROM su0 QUALIFY row_number() OVER (PARTITION BY flow_key, src ORDER BY round(w, 9) DESC, dst) <= 32)"""


@query("e5_successors", f"{_M}, {_LG}, {_SU} SELECT flow_key, src, dst, round(w, 6) AS w FROM su")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successors(recall_log(_mem(spark, sf_dir))).withColumn("w", F.round("w", 6))


def live_flows(flows: DataFrame, now: Column, cfg: Graph = DEFAULT.graph) -> DataFrame:
    """Flows (flow_key, last_turn) within their lifetime, the latest ``flow_cap`` of them."""
    return flows.where(now - F.col("last_turn") <= cfg.flow_ttl).orderBy(F.col("last_turn").desc(), "flow_key").limit(cfg.flow_cap)


@query("e8_flow_gc", f"{_M}, fl AS (SELECT actor_key AS flow_key, max(turn) AS last_turn FROM mem GROUP BY 1) SELECT flow_key, last_turn FROM fl WHERE {_NOW} - last_turn <= 128 ORDER BY last_turn DESC, flow_key LIMIT 256")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _mem(spark, sf_dir)
    flows = mem.groupBy(F.col("actor_key").alias("flow_key")).agg(F.max("turn").alias("last_turn"))
    return live_flows(_with_now(flows, mem), F.col("now")).drop("now")


def activation_events(mem: DataFrame, cfg: Activation = DEFAULT.activation) -> DataFrame:
    kind = F.element_at(F.array(F.lit("bind"), F.lit("recall"), F.lit("adopt")), (F.col("turn") % 3 + 1).cast("int"))
    amount = F.when(kind == "bind", cfg.bind).when(kind == "recall", cfg.recall).otherwise(cfg.adopt)
    return mem.select("anchor", "turn", kind.alias("reason"), amount.alias("amount"))


class Active:
    """The strength of one topic and its open window."""

    def __init__(self, anchor: str):
        self.anchor, self.strength, self.last, self.window = anchor, 0.0, None, None


def activation_step(cfg: Activation):
    """Decayed running strength, at most ``most``.

    A window opens when the strength reaches ``open_at`` and closes at the
    touch that finds it decayed below ``close_below``.
    """

    def step(s: Active, row: dict) -> list[tuple]:
        turn, out = row["turn"], []
        if s.last is not None:
            s.strength *= cfg.decay ** (turn - s.last)
            if s.window and s.strength < cfg.close_below:
                out.append((s.anchor, turn, s.strength, *s.window, "decay", False))
                s.window = None
        s.strength = min(cfg.most, s.strength + row["amount"])
        s.last = turn
        if s.window:
            start, _, peak, at, touches, why = s.window
            if s.strength > peak:
                peak, at = s.strength, turn
            s.window = (start, turn, peak, at, touches + 1, why)
        elif s.strength >= cfg.open_at:
            s.window = (turn, turn, s.strength, turn, 1, row["reason"])
        out.append((s.anchor, turn, s.strength, None, None, None, None, None, None, "touch", s.window is not None))
        return out

    return step


def _drain(s: Active) -> list[tuple]:
    return [(s.anchor, s.last, s.strength, *s.window, "open", True)] if s.window else []


ACTIVATION_SCHEMA = "anchor string, turn long, strength double, start_turn long, last_turn long, peak double, peak_turn long, touches long, open_reason string, kind string, is_open boolean"


def activations(events: DataFrame, cfg: Activation = DEFAULT.activation) -> DataFrame:
    return keyed_fold(events, "anchor", ["turn"], Active, activation_step(cfg), ACTIVATION_SCHEMA, _drain)


_AC = """ae AS (SELECT anchor, turn, ([1.0, 0.1, 0.18])[turn % 3 + 1]::DOUBLE AS amount, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS n FROM mem),
ac AS (WITH RECURSIVE f AS (SELECT anchor, turn, n, least(8.0, amount)::DOUBLE AS strength FROM ae WHERE n = 1 UNION ALL SELECT a.anchor, a.turn, a.n, least(8.0, f.strength * pow(0.985, a.turn - f.turn) + a.amount)::DOUBLE FROM f JOIN ae a ON a.anchor = f.anchor AND a.n = f.n + 1) SELECT * FROM f)"""


@query("h1_activation", f"{_M}, {_AC} SELECT anchor, turn, round(strength, 6) AS strength FROM ac")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activations(activation_events(_mem(spark, sf_dir))).where("kind = 'touch'")
    return a.select("anchor", "turn", F.round("strength", 6).alias("strength"))


_AW = """ae AS (SELECT anchor, turn, ([1.0, 0.1, 0.18])[turn % 3 + 1]::DOUBLE AS amount, (['bind', 'recall', 'adopt'])[turn % 3 + 1] AS why, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS n FROM mem),
aw AS MATERIALIZED (WITH RECURSIVE f AS (
  SELECT anchor, n, turn, least(8.0, amount)::DOUBLE AS strength, CASE WHEN amount >= 0.25 THEN {'start_turn': turn, 'last_turn': turn, 'peak': least(8.0, amount)::DOUBLE, 'peak_turn': turn, 'touches': 1::BIGINT, 'open_reason': why} END AS w, NULL::STRUCT(start_turn BIGINT, last_turn BIGINT, peak DOUBLE, peak_turn BIGINT, touches BIGINT, open_reason VARCHAR) AS ended FROM ae WHERE n = 1
  UNION ALL
  SELECT anchor, n, turn, s, CASE WHEN kept IS NOT NULL THEN {'start_turn': kept.start_turn, 'last_turn': turn, 'peak': greatest(kept.peak, s), 'peak_turn': CASE WHEN s > kept.peak THEN turn ELSE kept.peak_turn END, 'touches': kept.touches + 1, 'open_reason': kept.open_reason}
    WHEN s >= 0.25 THEN {'start_turn': turn, 'last_turn': turn, 'peak': s, 'peak_turn': turn, 'touches': 1::BIGINT, 'open_reason': why} END, CASE WHEN d < 0.12 THEN w END
  FROM (SELECT f.anchor, x.n, x.turn, x.why, w, f.strength * pow(0.985, x.turn - f.turn) AS d, least(8.0, f.strength * pow(0.985, x.turn - f.turn) + x.amount)::DOUBLE AS s, CASE WHEN f.strength * pow(0.985, x.turn - f.turn) >= 0.12 THEN w END AS kept FROM f JOIN ae x ON x.anchor = f.anchor AND x.n = f.n + 1))
  SELECT * FROM f),
win AS (SELECT anchor, ended AS w, 'decay' AS kind FROM aw WHERE ended IS NOT NULL UNION ALL SELECT anchor, arg_max(w, n), 'open' FROM aw GROUP BY anchor HAVING arg_max(w IS NOT NULL, n))"""


@query("h2_windows", f"{_M}, {_AW} SELECT anchor, w.start_turn AS start_turn, w.last_turn AS last_turn, round(w.peak, 6) AS peak, w.peak_turn AS peak_turn, w.touches AS touches, w.open_reason AS open_reason, kind FROM win QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY w.start_turn DESC) <= 128")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open windows, the last 128 of a topic."""
    w = activations(activation_events(_mem(spark, sf_dir))).where("kind <> 'touch'")
    n = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("start_turn").desc()))
    return w.withColumn("n", n).where(F.col("n") <= DEFAULT.activation.windows_cap).drop("n", "turn", "strength", "is_open").withColumn("peak", F.round("peak", 6))


@query("h3_active_topics", f"{_M}, {_AC}, la AS (SELECT anchor, arg_max(strength, n) * pow(0.985, {_NOW} - max(turn)) AS strength FROM ac GROUP BY 1) SELECT anchor, round(strength, 6) AS strength FROM la WHERE strength >= 0.25 ORDER BY strength DESC, anchor LIMIT 10")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _mem(spark, sf_dir)
    a = activations(activation_events(mem)).where("kind = 'touch'").groupBy("anchor").agg(F.max_by("strength", "turn").alias("s"), F.max("turn").alias("t"))
    a = _with_now(a, mem).select("anchor", (F.col("s") * F.pow(F.lit(DEFAULT.activation.decay), F.col("now") - F.col("t"))).alias("strength"))
    return a.where(F.col("strength") >= DEFAULT.activation.open_at).orderBy(F.col("strength").desc(), "anchor").limit(10).select("anchor", F.round("strength", 6).alias("strength"))


def activation_prior(strength: Column, sim: Column, age: Column, is_open: Column, cfg: Activation = DEFAULT.activation) -> Column:
    raw = cfg.prior_weight * (strength / cfg.most) * ((sim - cfg.prior_gate) / (1 - cfg.prior_gate)) * F.exp(-age / cfg.recency) * F.when(is_open, 1.0).otherwise(cfg.closed_factor)
    return F.when(sim < cfg.prior_gate, 0.0).otherwise(F.least(F.lit(cfg.prior_most), raw))


@query("h4_prior", f"{_M}, {NODES}, {_AC} SELECT ac.anchor, ac.turn, round(CASE WHEN list_cosine_similarity(n.centroid, m.vec) < 0.35 THEN 0 ELSE least(0.1, 0.08 * (ac.strength / 8.0) * ((list_cosine_similarity(n.centroid, m.vec) - 0.35) / 0.65) * exp(-({_NOW} - ac.turn) / 64.0) * CASE WHEN ac.strength >= 0.25 THEN 1.0 ELSE 0.6 END) END, 6)::DOUBLE AS prior FROM ac JOIN nodes n USING (anchor) JOIN mem m ON m.turn = ac.turn")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _mem(spark, sf_dir)
    a = _with_now(activations(activation_events(mem)).where("kind = 'touch'").select("anchor", "turn", "strength"), mem)
    a = a.join(topic_nodes(mem).select("anchor", "centroid"), "anchor").join(mem.select("turn", "vec"), "turn")
    p = activation_prior(F.col("strength"), cosine(F.col("centroid"), F.col("vec")), F.col("now") - F.col("turn"), F.col("strength") >= 0.25)
    return a.select("anchor", "turn", F.round(p, 6).alias("prior"))


@query("h5_nodes", f"{_M}, {NODES} SELECT anchor, memory_count, last_turn, round(centroid[1], 6) AS first FROM nodes")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_nodes(_mem(spark, sf_dir)).select("anchor", "memory_count", "last_turn", F.round(F.col("centroid")[0], 6).alias("first"))
