"""Identity keys, trust scores and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT, Guard
from ..plans.fold import keyed_fold
from ..sources.fixtures import TURNS, turns
from .text import INJECTION_MARKERS, RISK_SQL, risk, risk_reasons, trim

ANCHOR_FREE_SCOPES = ("stdin", "system", "unknown", "global")
_T = f"WITH {TURNS}"
#: Identities as hosts send them: parts missing, padded, explicit scopes.
IDENTITIES = [(1, "live", "7", "u1", "ann", ""), (2, "", "", "", "", ""), (3, "stdin", "", "", "", ""), (4, " chat ", " r ", "", " bob ", ""), (5, "live", "", "u2", "", "my:scope"), (6, "", "9", "", "", ""), (7, "system", "1", "u", "n", "global")]
_I = "i(id, source, room_id, user_id, nickname, scope) AS (VALUES " + ", ".join(str(x) for x in IDENTITIES) + ")"


def identities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IDENTITIES, "id long, source string, room_id string, user_id string, nickname string, scope string")


def _or(c: Column, other: str) -> Column:
    return F.when(c == "", F.lit(other)).otherwise(c)


def _clean(name: str) -> Column:
    return trim(F.coalesce(F.col(name), F.lit("")))


def actor_key() -> Column:
    """<source or unknown>[/room:<room>]/(uid:<id> | nick:<n> | anon)"""
    room, user, nick = _clean("room_id"), _clean("user_id"), _clean("nickname")
    who = F.when(user != "", F.concat(F.lit("uid:"), user)).when(nick != "", F.concat(F.lit("nick:"), nick)).otherwise("anon")
    return F.concat_ws("/", _or(_clean("source"), "unknown"), F.when(room != "", F.concat(F.lit("room:"), room)), who)


def scope_key(explicit: Column, strategy: str = "source_room") -> Column:
    source, room = _or(_clean("source"), "unknown"), _clean("room_id")
    derived = {"global": F.lit("global"), "source": source, "source_room_user": actor_key()}.get(strategy, F.concat_ws(":", source, F.when(room != "", room)))
    return F.when(trim(F.coalesce(explicit, F.lit(""))) != "", trim(explicit)).otherwise(derived)


_ACTOR = "CASE WHEN trim(source) = '' THEN 'unknown' ELSE trim(source) END || CASE WHEN trim(room_id) = '' THEN '' ELSE '/room:' || trim(room_id) END || '/' || CASE WHEN trim(user_id) <> '' THEN 'uid:' || trim(user_id) WHEN trim(nickname) <> '' THEN 'nick:' || trim(nickname) ELSE 'anon' END"
_SCOPE = "CASE WHEN trim(scope) <> '' THEN trim(scope) ELSE CASE WHEN trim(source) = '' THEN 'unknown' ELSE trim(source) END || CASE WHEN trim(room_id) = '' THEN '' ELSE ':' || trim(room_id) END END"
_WHO = f"{_T}, {_I}, w AS (SELECT id, source, room_id, user_id, nickname, scope FROM i UNION ALL SELECT turn + 100, source, room_id, user_id, nickname, '' FROM turns)"


def _whos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return identities(spark).unionByName(t.select((F.col("turn") + 100).alias("id"), "source", "room_id", "user_id", "nickname", F.lit("").alias("scope")))


@query("g1_keys", f"{_WHO} SELECT id, {_ACTOR} AS actor_key, {_SCOPE} AS scope_key, CASE WHEN trim(scope) <> '' THEN trim(scope) ELSE {_ACTOR} END AS user_scope FROM w")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whos(spark, sf_dir).select("id", actor_key().alias("actor_key"), scope_key(F.col("scope")).alias("scope_key"), scope_key(F.col("scope"), "source_room_user").alias("user_scope"))


def scoped_anchor(scope: Column, anchor: Column) -> Column:
    """<scope>|<anchor>, once; scopes that name no place leave the anchor as it is."""
    plain = (scope == "") | scope.isin(*ANCHOR_FREE_SCOPES) | F.startswith(anchor, F.concat(scope, F.lit("|")))
    return F.when(plain | (anchor == ""), anchor).otherwise(F.concat(scope, F.lit("|"), anchor))


@query("g2_scoped_anchor", f"{_WHO}, k AS (SELECT id, {_SCOPE} AS s FROM w), a AS (SELECT id, CASE WHEN s IN ('stdin', 'system', 'unknown', 'global') THEN 'S:' || id ELSE s || '|S:' || id END AS anchor FROM k) SELECT id, anchor, anchor AS again FROM a")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _whos(spark, sf_dir).select("id", scope_key(F.col("scope")).alias("s"))
    k = k.withColumn("anchor", scoped_anchor(F.col("s"), F.concat(F.lit("S:"), F.col("id"))))
    return k.select("id", "anchor", scoped_anchor(F.col("s"), F.col("anchor")).alias("again"))


def admissions(t: DataFrame) -> DataFrame:
    """turn, actor_key, risk, reasons and identity of each user message."""
    return t.select("turn", actor_key().alias("actor_key"), scope_key(F.lit("")).alias("scope_key"), "source", "user_id", "nickname", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("event_ts")).alias("ts"), risk(F.col("user_input")).alias("risk"), risk_reasons(trim(F.col("user_input"))).alias("reasons"))


class Credit:
    """The running trust of one actor."""

    def __init__(self, key: str):
        self.key, self.credit, self.seen, self.blocked_until, self.last_seen = key, None, 0, 0, 0


def credit_step(cfg: Guard):
    """One message: credit before and after, blocked or not, and whether a note is due at the next one."""

    def step(s: Credit, row: dict) -> list[tuple]:
        if s.credit is None:
            s.credit = cfg.live_credit if row["source"] in cfg.live_sources else cfg.default_credit
        now, r, before = row["ts"], row["risk"], s.credit
        if s.blocked_until and now >= s.blocked_until:
            s.blocked_until = 0 if before >= cfg.restore_at else now + cfg.block_seconds
        decay, penalty = min(0.999, max(0.80, cfg.decay)), max(0.05, cfg.penalty)
        after = before * decay + (cfg.bonus if r <= cfg.clean_risk else -penalty * r)
        s.credit = after = min(1.0, max(0.0, after))
        blocks = after <= cfg.block_below
        if blocks:
            s.blocked_until = max(s.blocked_until, now + cfg.block_seconds)
        down = before > cfg.note_below >= after
        note = down or abs(after - before) >= cfg.note_change or r >= cfg.note_risk or blocks
        if row["source"] not in ("stdin", "system"):
            note = note or s.seen == 0
        s.seen += 1
        s.last_seen = now
        return [(row["turn"], s.key, float(before), float(after), float(r), s.blocked_until > now, s.blocked_until, note)]

    return step


CREDIT_SCHEMA = "turn long, actor_key string, before double, after double, risk double, blocked boolean, blocked_until long, note boolean"


def credits(adm: DataFrame, cfg: Guard = DEFAULT.guard) -> DataFrame:
    return keyed_fold(adm.select("actor_key", "turn", "source", "ts", "risk"), "actor_key", ["turn"], Credit, credit_step(cfg), CREDIT_SCHEMA)


def admission_sql(start: float) -> str:
    """Admissions and running credits from ``start`` on, as ``blocks``."""
    return f"""x AS (SELECT *, regexp_replace(user_input, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS s FROM turns),
adm AS (SELECT turn, {_ACTOR} AS actor_key, source, epoch(event_ts)::BIGINT AS ts, {RISK_SQL} AS risk, row_number() OVER (PARTITION BY {_ACTOR} ORDER BY turn) AS n FROM x),
cr AS (WITH RECURSIVE f AS (
  SELECT n, actor_key, turn, ts, risk, {start}::DOUBLE AS before, least(1.0, greatest(0.0, {start} * 0.985 + CASE WHEN risk <= 0.05 THEN 0.02 ELSE -0.4 * risk END))::DOUBLE AS after, 0::BIGINT AS held FROM adm WHERE n = 1
  UNION ALL
  SELECT a.n, a.actor_key, a.turn, a.ts, a.risk, f.after, least(1.0, greatest(0.0, f.after * 0.985 + CASE WHEN a.risk <= 0.05 THEN 0.02 ELSE -0.4 * a.risk END))::DOUBLE,
    CASE WHEN f.after <= 0.25 THEN greatest(CASE WHEN f.held > 0 AND f.ts >= f.held THEN CASE WHEN f.before >= 0.75 THEN 0 ELSE f.ts + 3600 END ELSE f.held END, f.ts + 3600) ELSE CASE WHEN f.held > 0 AND f.ts >= f.held THEN CASE WHEN f.before >= 0.75 THEN 0 ELSE f.ts + 3600 END ELSE f.held END END
  FROM f JOIN adm a ON a.actor_key = f.actor_key AND a.n = f.n + 1) SELECT * FROM f),
credit AS MATERIALIZED (SELECT *, CASE WHEN held > 0 AND ts >= held THEN CASE WHEN before >= 0.75 THEN 0 ELSE ts + 3600 END ELSE held END AS h0 FROM cr),
blocks AS MATERIALIZED (SELECT *, CASE WHEN after <= 0.25 THEN greatest(h0, ts + 3600) ELSE h0 END AS blocked_until FROM credit)"""


_ADM = admission_sql(DEFAULT.guard.live_credit)
#: Actors who are trusted from the start, for queries whose path would else be shut for all of the fixture's short lives.
TRUSTED = DEFAULT.with_values("guard", live_credit=0.9).guard


def _credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credits(admissions(turns(spark, sf_dir)))


@query("g3_credit", f"{_T}, {_ADM} SELECT turn, actor_key, round(before, 6) AS before, round(after, 6) AS after, round(risk, 6) AS risk FROM blocks")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _credits(spark, sf_dir)
    return c.select("turn", "actor_key", *[F.round(x, 6).alias(x) for x in ("before", "after", "risk")])


@query("g4_blocks", f"{_T}, {_ADM} SELECT turn, actor_key, blocked_until > ts AS blocked, blocked_until FROM blocks")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credits(spark, sf_dir).select("turn", "actor_key", "blocked", "blocked_until")


@query("g5_notes", f"{_T}, {_ADM}, nt AS (SELECT turn, actor_key, n = 1 OR (before > 0.65 AND after <= 0.65) OR abs(after - before) >= 0.12 OR risk >= 0.6 OR after <= 0.25 AS note FROM blocks) SELECT turn, actor_key, note, coalesce(lag(note) OVER (PARTITION BY actor_key ORDER BY turn), false) AS shown FROM nt")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note made at one message is shown, once, at the actor's next."""
    c = _credits(spark, sf_dir)
    return c.select("turn", "actor_key", "note", F.coalesce(F.lag("note").over(Window.partitionBy("actor_key").orderBy("turn")), F.lit(False)).alias("shown"))


def keep_recent(actors: DataFrame, most: int) -> DataFrame:
    """The actors seen last, ties by key; the sort keeps only ``most`` rows a task."""
    return actors.orderBy(F.col("last_seen").desc(), F.col("actor_key").desc()).limit(most)


@query("g6_actor_lru", f"{_T}, {_ADM} SELECT actor_key, max(ts) AS last_seen FROM adm GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 40")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = admissions(turns(spark, sf_dir)).groupBy("actor_key").agg(F.max("ts").alias("last_seen"))
    return keep_recent(a, 40)


def gates(c: DataFrame, cfg: Guard = DEFAULT.guard) -> DataFrame:
    """Recall uses the credit before a message, writing the one after it; a block shuts all."""
    free = ~F.col("blocked")
    history = free & (F.col("after") >= cfg.history_at)
    topic = history & (F.col("after") >= cfg.topic_at)
    return c.select("turn", "actor_key", (free & (F.col("before") >= cfg.recall_at)).alias("recall"), history.alias("history"), topic.alias("topic"), (topic & (F.col("after") >= cfg.write_at)).alias("write"))


_GATE = "blocked_until <= ts"


@query("g7_gates", f"{_T}, {_ADM} SELECT turn, actor_key, {_GATE} AND before >= 0.7 AS recall, {_GATE} AND after >= 0.7 AS history, {_GATE} AND after >= 0.7 AS topic, {_GATE} AND after >= 0.75 AS write FROM blocks")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(_credits(spark, sf_dir))


def source_label(scope: Column, actor: Column, credit: Column) -> Column:
    source, room, user, nick = (_clean(x) for x in ("source", "room_id", "user_id", "nickname"))

    def part(name: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"{name}="), c))

    bare = (room == "") & (user == "") & (nick == "") & source.isin("", "stdin", "system")
    said = F.concat_ws(" ", part("source", source), part("room", room), part("user", user), part("nick", nick), part("scope", scope), part("actor", actor), F.format_string("credit=%.2f", credit))
    return F.when(bare, F.lit("")).otherwise(F.concat(F.lit("【事件来源】"), said))


@query("g8_source_label", f"{_WHO}, k AS (SELECT *, {_ACTOR} AS actor, {_SCOPE} AS sc FROM w) SELECT id, CASE WHEN trim(source) IN ('', 'stdin', 'system') AND trim(room_id) = '' AND trim(user_id) = '' AND trim(nickname) = '' THEN '' ELSE '【事件来源】' || concat_ws(' ', CASE WHEN trim(source) <> '' THEN 'source=' || trim(source) END, CASE WHEN trim(room_id) <> '' THEN 'room=' || trim(room_id) END, CASE WHEN trim(user_id) <> '' THEN 'user=' || trim(user_id) END, CASE WHEN trim(nickname) <> '' THEN 'nick=' || trim(nickname) END, 'scope=' || sc, 'actor=' || actor, printf('credit=%.2f', 0.25 + (id % 4) / 4.0)) END AS label FROM k")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whos(spark, sf_dir).select("id", source_label(scope_key(F.col("scope")), actor_key(), F.lit(0.25) + (F.col("id") % 4) / 4.0).alias("label"))


@query("g9_guard_state", f"{_T}, {_ADM} SELECT actor_key, round(arg_max(after, turn), 6) AS credit, count(*) AS seen, arg_max(blocked_until, turn) AS blocked_until FROM blocks GROUP BY 1")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that is saved: one row an actor."""
    c = _credits(spark, sf_dir)
    return c.groupBy("actor_key").agg(F.round(F.max_by("after", "turn"), 6).alias("credit"), F.count("*").alias("seen"), F.max_by("blocked_until", "turn").alias("blocked_until"))


__all__ = ["INJECTION_MARKERS", "actor_key", "credits", "gates", "scope_key", "scoped_anchor", "source_label"]
