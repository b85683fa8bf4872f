"""Routing of interleaved messages into threads of a scope.

One plain-Python machine per scope holds the open streams.  ``Router.route``
decides where a message goes, ``observe`` updates that stream and ``stage``
holds its event until it is settled; the batch fold and the streaming wrapper
run the same step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..config import DEFAULT
from ..config import Router as Settings
from ..plans.fold import keyed_fold
from ..sources.fixtures import MEMORIES, TURNS, memories, turns
from .guard import actor_key, scope_key
from .segments import direction, sql_mean
from .text import _CUE, _MENTION, _REACTION, has_cue, is_reaction, mentions

_T = f"WITH {TURNS}"


@dataclass
class Stream:
    id: int
    segment: int
    start: int
    window: list = field(default_factory=list)
    #: directions of the mean of the window, of the last and of the first vector, one row each
    points: np.ndarray | None = None
    last_turn: int = 0
    last_actor: str = ""
    confirmed: int = 0
    confidence: float = 0.0
    stability: float = 0.0
    participants: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)
    addressees: dict = field(default_factory=dict)
    pending: list = field(default_factory=list)
    local: list = field(default_factory=list)
    orphan: bool = False
    ambient: bool = False

    @property
    def counts(self) -> bool:
        return not (self.orphan or self.ambient)


@dataclass
class Choice:
    """Where a message goes, and how sure that is."""

    decision: str = "drop"
    reason: str = "drop_missing_vec"
    stream: int | None = None
    confidence: float = 0.0
    pending_only: bool = False
    boundary: bool = False
    merged: bool = False
    best: float = -1.0
    second: float = -1.0
    mode: str = "single"
    local_sequence: bool = False
    thread_key: str = ""
    segment_key: str = ""


def stability_of(s: Stream, turn: int, cfg: Settings) -> float:
    age = max(0, turn - s.last_turn)
    sure = min(1.25, max(0.0, s.confidence)) / 1.25
    v = 0.45 * min(1.0, s.confirmed / cfg.stability_turns) + 0.20 * min(1.0, len(s.participants) / 2) + 0.20 * sure + 0.15 / (1 + age / cfg.cue_recent)
    return min(1.0, max(0.0, v))


class Router:
    def __init__(self, scope: str, cfg: Settings = DEFAULT.router):
        self.scope, self.cfg = scope, cfg
        self.streams: dict[int, Stream] = {}
        self.next_stream = self.next_segment = 1
        self.last_assigned, self.streak, self.hold_until = None, 0, 0
        self.lost: list[dict] = []
        #: (score, likeness, stream, stability) of the streams at the message routed last, best first
        self.ranked: list[tuple[float, float, int, float]] = []

    def _open(self, turn: int, vec: np.ndarray, actor: str, **kind: bool) -> Stream:
        s = Stream(self.next_stream, self.next_segment, turn, [vec], np.stack([direction(vec)] * 3), turn, actor, **kind)
        self.next_stream += 1
        self.next_segment += 1
        self.streams[s.id] = s
        return s

    def _renew(self, s: Stream, turn: int, vec: np.ndarray, actor: str) -> None:
        """A new segment of the same thread begins with this message."""
        s.segment, self.next_segment = self.next_segment, self.next_segment + 1
        s.start, s.window, s.points, s.last_turn, s.last_actor = turn, [vec], np.stack([direction(vec)] * 3), turn, actor

    def _drop(self, keep) -> None:
        """Streams go, but what they still held is committed first."""
        for i in [i for i, s in self.streams.items() if not keep(s)]:
            self.lost += self.streams.pop(i).pending

    def _evict(self, turn: int) -> None:
        def keep(s: Stream) -> bool:
            age = turn - s.last_turn
            if s.orphan and age >= self.cfg.orphan_stale:
                return False
            return bool(s.pending or s.local) or age < self.cfg.stale

        self._drop(keep)

    def score(self, s: Stream, row: dict) -> tuple[float, float]:
        """How well a message fits a stream, and its likeness for the reset test."""
        cfg, turn = self.cfg, row["turn"]
        c, t, h = (s.points @ row["unit"]).tolist()
        total = cfg.w_centroid * c + cfg.w_tail * t + cfg.w_head * h
        if row["actor"] and row["actor"] == s.last_actor:
            total += cfg.same_actor
        elif s.participants.get(row["actor"]):
            total += cfg.participant
        named = [a for a in row["mentions"] if a in s.aliases]
        told = [a for a in row["mentions"] if a in s.addressees]
        if not named and not told:
            text = row["low"]
            named = [a for a in s.aliases if len(a.encode()) >= 3 and a in text]
            told = [a for a in s.addressees if a not in row["mentions"] and len(a.encode()) >= 3 and a in text]
        total += min(2, len(named)) * cfg.explicit + min(2, len(told)) * cfg.addressee
        age = max(0, turn - s.last_turn)
        if row["cue"] and age <= cfg.cue_recent:
            total += cfg.cue * (1 - min(0.85, age / cfg.cue_recent))
        total += cfg.stability * stability_of(s, turn, cfg)
        return total - cfg.age * min(age, cfg.age_cap), max(t, c)

    def _attachable(self, s: Stream | None, turn: int) -> bool:
        return s is not None and not s.orphan and max(0, turn - s.last_turn) <= self.cfg.recent_turns

    def route(self, row: dict) -> Choice:
        cfg, turn, actor = self.cfg, row["turn"], row["actor"]
        self.ranked = []
        if row["vec"] is None or not len(row["vec"]) or turn <= 0:
            return Choice()
        vec = row["vec"] = np.asarray(row["vec"], np.float64)
        row["unit"] = direction(vec)
        self._evict(turn)
        ranked = sorted(((*self.score(s, row), s) for s in self.streams.values() if not s.ambient), key=lambda x: (-x[0], x[2].id))
        self.ranked = [(v, like, s.id, stability_of(s, turn, cfg)) for v, like, s in ranked]
        ch = Choice(best=ranked[0][0] if ranked else -1.0, second=ranked[1][0] if len(ranked) > 1 else -1.0)
        best = ranked[0][2] if ranked else None
        real = sum(s.counts for s in self.streams.values())
        reaction = None
        if best is not None and ch.best < cfg.assign and row["reaction"]:
            front = next(((v, s) for v, _, s in ranked if s.id == self.last_assigned), None)
            if self._attachable(best, turn) and ch.best >= cfg.reaction_at:
                reaction = (ch.best, best, "attach_reaction")
            elif front and self._attachable(front[1], turn) and (front[0] >= cfg.recent_at or stability_of(front[1], turn, cfg) >= cfg.recent_stability):
                reaction = (*front, "attach_recent")
        if best is not None and ch.best >= cfg.assign:
            ch.decision, ch.reason, ch.confidence, s = "attach", "promote_orphan" if best.orphan else "assign", ch.best, best
            best.orphan = False
            if ranked[0][1] < cfg.reset:
                self._renew(best, turn, vec, actor)
                ch.boundary, ch.reason = True, "reset_topic"
        elif reaction:
            value, s, ch.reason = reaction
            ch.decision, ch.confidence = "attach", min(1.25, max(0.0, value + 0.04))
        elif row["reaction"] and real > 0:
            s = next((x for x in self.streams.values() if x.ambient), None) or self._open(turn, vec, actor, ambient=True)
            ch.decision, ch.reason, ch.pending_only, ch.confidence = "ambient", "ambient_attach", True, max(0.0, ch.best)
        elif best is not None and ch.best >= cfg.pending and ((len(ranked) > 1 and ch.best - ch.second < cfg.margin) or real >= cfg.max_streams):
            s = best
            ch.decision = ch.reason = "keep_pending"
            ch.pending_only, ch.confidence = True, ch.best
        elif real < cfg.max_streams:
            s = self._open(turn, vec, actor)
            ch.decision, ch.reason, ch.confidence = "open", "create", 1.0
        else:
            s = self._open(turn, vec, actor, orphan=True)
            ch.decision, ch.reason, ch.pending_only, ch.confidence = "orphan", "orphan_overflow", True, max(0.0, ch.best)
        ch.stream = s.id
        self._settle(ch, s, row)
        return ch

    def _settle(self, ch: Choice, s: Stream, row: dict) -> None:
        """Streak, dominance merge, local sequence and keys after a decision."""
        cfg, turn = self.cfg, row["turn"]
        if ch.pending_only:
            self.streak = 0
        elif self.last_assigned == s.id:
            self.streak += 1
        else:
            self.last_assigned, self.streak = s.id, 1
        several = sum(x.counts for x in self.streams.values()) > 1
        if several and self.streak >= cfg.merge_streak and all(turn - x.last_turn >= cfg.merge_idle for x in self.streams.values() if x is not s):
            self._drop(lambda x: x is s)
            self._renew(s, turn, row["vec"], row["actor"])
            ch.boundary = ch.merged = True
            ch.reason, self.streak, several = "merge", 1, False
        ch.mode = "split" if several else "single"
        if several:
            self.hold_until = max(self.hold_until, turn + max(cfg.hold, cfg.commit_idle))
        elif ch.boundary:
            self.hold_until = max(self.hold_until, turn + cfg.commit_idle)
        ch.local_sequence = ch.pending_only or several or turn <= self.hold_until
        ch.thread_key = f"{self.scope}$th:{s.id}"
        ch.segment_key = f"{ch.thread_key}/seg:{s.segment}"

    def observe(self, ch: Choice, row: dict) -> None:
        """What the stream learns from the message; a message kept aside teaches nothing."""
        s = self.streams.get(ch.stream)
        if s is None or (ch.pending_only and s.counts):
            return
        vec = row["vec"] = np.asarray(row["vec"], np.float64)
        s.window = [*s.window, vec][-self.cfg.window :] if s.window[-1] is not vec else s.window
        s.points[0], s.points[1] = direction(np.mean(s.window, axis=0)), direction(vec)
        s.confirmed += not ch.pending_only
        s.last_turn, s.last_actor = row["turn"], row["actor"]
        s.participants[row["actor"]] = s.participants.get(row["actor"], 0) + 1
        if row["alias"]:
            s.aliases[row["alias"]] = s.aliases.get(row["alias"], 0) + 1
        for a in row["mentions"]:
            s.addressees[a] = s.addressees.get(a, 0) + 1
        s.confidence = 0.75 * s.confidence + 0.25 * ch.confidence
        s.stability = stability_of(s, row["turn"], self.cfg)

    def stage(self, ch: Choice, row: dict) -> list[dict]:
        """Events that are settled now.

        Streams other than the current one keep one event, none once they are
        idle; a boundary empties the current one; otherwise it is emptied when
        a chunk is full, or kept to one event while sequences are local.
        """
        cfg, turn, out = self.cfg, row["turn"], self.lost
        self.lost = []
        for s in self.streams.values():
            if s.id != ch.stream or ch.boundary:
                keep = 0 if turn - s.last_turn >= cfg.commit_idle or s.id == ch.stream else 1
                cut = len(s.pending) - keep
                if cut > 0:
                    out, s.pending = out + s.pending[:cut], s.pending[cut:]
        s = self.streams.get(ch.stream)
        if s is None:
            return out
        event = {"turn": turn, "thread_key": ch.thread_key, "segment_key": ch.segment_key}
        if ch.pending_only:
            s.local = [*s.local, event][-(cfg.ambient_cap if s.ambient else cfg.local_cap) :]
            s.last_turn = turn
            return out
        s.pending += [{**e, "thread_key": ch.thread_key, "segment_key": ch.segment_key} for e in s.local] + [event]
        s.local = []
        keep = 1 if ch.local_sequence else (0 if len(s.pending) >= cfg.commit_chunk else len(s.pending))
        cut = len(s.pending) - keep
        if cut > 0:
            out, s.pending = out + s.pending[:cut], s.pending[cut:]
        return out

    def drain(self) -> list[dict]:
        out = self.lost + [e for s in self.streams.values() for e in s.pending]
        for s in self.streams.values():
            s.pending = []
        self.lost = []
        return out

    def unsettled(self) -> list[tuple[int, dict]]:
        """Events that are still held, each with its stream."""
        return [(s.id, e) for s in self.streams.values() for e in [*s.pending, *s.local]]

    def export(self) -> list[tuple]:
        """The scope's state as plain data: one row a stream."""
        return [(self.scope, self.next_stream, self.next_segment, s.id, s.segment, s.confirmed, len(s.pending), len(s.local)) for s in self.streams.values()]


ROUTE_SCHEMA = "kind string, scope_key string, turn long, at_turn long, decision string, reason string, stream long, thread_key string, segment_key string, confidence double, best double, second double, pending_only boolean, boundary boolean, merged boolean, local_sequence boolean, mode string"


def route_step(r: Router, row: dict) -> list[tuple]:
    """One routed row, and one committed row for each event that this message settles."""
    ch = r.route(row)
    r.observe(ch, row)
    turn = row["turn"]
    routed = ("routed", r.scope, turn, turn, ch.decision, ch.reason, ch.stream, ch.thread_key, ch.segment_key, float(ch.confidence), float(ch.best), float(ch.second), ch.pending_only, ch.boundary, ch.merged, ch.local_sequence, ch.mode)
    return [routed, *(_committed(r, e, turn) for e in r.stage(ch, row))]


def _committed(r: Router, e: dict, at: int) -> tuple:
    return ("committed", r.scope, e["turn"], at, None, None, None, e["thread_key"], e["segment_key"], None, None, None, None, None, None, None, None)


def _finish(r: Router) -> list[tuple]:
    held = [("held", r.scope, e["turn"], 0, None, None, i, e["thread_key"], e["segment_key"], None, None, None, None, None, None, None, None) for i, e in r.unsettled()]
    return held + [_committed(r, e, 0) for e in r.drain()]


def score_step(r: Router, row: dict) -> list[tuple]:
    """One row for each stream that a message was held against."""
    route_step(r, row)
    return [(r.scope, row["turn"], i, n, float(score), float(like), float(stable)) for n, (score, like, i, stable) in enumerate(r.ranked, 1)]


#: Fixed values of the fixture: what every fourth message says instead, since the corpus has no reactions, cues or mentions.
CHAT = ("哈哈哈", "666", "[笑][哭]", "before that, continue", "@u5 reply", "嗯")


def chat(t: DataFrame) -> DataFrame:
    """The turns, some of which react, refer back or mention somebody."""
    said = F.element_at(F.array(*[F.lit(x) for x in CHAT]), (F.floor(F.col("turn") / 4) % len(CHAT) + 1).cast("int"))
    return t.withColumn("user_input", F.when(F.col("turn") % 4 == 2, said).otherwise(F.col("user_input")))


def router_input(t: DataFrame) -> DataFrame:
    """The columns the machine reads; what is text work is done by expressions."""
    text = F.col("user_input")
    return t.select(scope_key(F.lit("")).alias("scope_key"), "turn", "vec", actor_key().alias("actor"), F.lower(F.col("user_id")).alias("alias"), F.lower(text).alias("low"), mentions(text).alias("mentions"), has_cue(text).alias("cue"), is_reaction(text).alias("reaction"))


def _enabled(t: DataFrame) -> DataFrame:
    return t.where(F.col("source").isin(*DEFAULT.router.sources))


def route(t: DataFrame) -> DataFrame:
    return keyed_fold(router_input(_enabled(t)), "scope_key", ["turn"], Router, route_step, ROUTE_SCHEMA, _finish)


def scores(t: DataFrame) -> DataFrame:
    """scope_key, turn, stream, rank, score, likeness, stability of every stream that a message was held against."""
    return keyed_fold(router_input(_enabled(t)), "scope_key", ["turn"], Router, score_step, "scope_key string, turn long, stream long, rank long, score double, likeness double, stability double")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route(chat(turns(spark, sf_dir)))


# The machine as a recursive query: one step a message, streams as a list of structures.
_EVENTS = "STRUCT(turn BIGINT, tk VARCHAR, sk VARCHAR)[]"
_STREAM = f"STRUCT(id INT, seg INT, win DOUBLE[][], cen DOUBLE[], head DOUBLE[], tail DOUBLE[], lt BIGINT, la VARCHAR, conf INT, sure DOUBLE, parts VARCHAR[], al VARCHAR[], adr VARCHAR[], pend {_EVENTS}, loc {_EVENTS}, orphan BOOLEAN, amb BOOLEAN)[]"
_FIELDS = ("id", "seg", "win", "cen", "head", "tail", "lt", "la", "conf", "sure", "parts", "al", "adr", "pend", "loc", "orphan", "amb")
_COS = "list_cosine_similarity"


def _layers(base: str, *added: str) -> str:
    """Columns added one layer upon the other, each of which may use those below."""
    for a in added:
        base = f"SELECT *, {a} FROM ({base})"
    return base


def _with(streams: str, when: str = "", **new: str) -> str:
    """Every stream, with some fields anew (where ``when`` holds)."""
    value = lambda k: f"CASE WHEN {when} THEN {new[k]} ELSE s.{k} END" if when else new[k]
    return f"list_transform({streams}, lambda s: {{{', '.join(f'{k!r}: {value(k) if k in new else "s." + k}' for k in _FIELDS)}}})"


_NEW = {"win": "[vec]", "cen": "vec", "head": "vec", "tail": "vec", "lt": "turn", "la": "actor"}
_STABLE = "least(1.0, greatest(0.0, 0.45 * least(1.0, s.conf / 4.0) + 0.2 * least(1.0, len(s.parts) / 2.0) + 0.2 * least(1.25, greatest(0.0, s.sure)) / 1.25 + 0.15 / (1 + greatest(0, turn - s.lt) / 6.0)))"
_LIVES = "NOT (s.orphan AND turn - s.lt >= 20) AND (len(s.pend) > 0 OR len(s.loc) > 0 OR turn - s.lt < 60)"
_HELD = f"""list_transform(list_filter(kept, lambda s: NOT s.amb), lambda s: {{'id': s.id, 'orphan': s.orphan, 'lt': s.lt, 'la': s.la, 'age': greatest(0, turn - s.lt), 'stab': {_STABLE}, 'c': {_COS}(s.cen, vec), 't': {_COS}(s.tail, vec), 'h': {_COS}(s.head, vec), 'part': list_contains(s.parts, actor),
  'named': len(list_filter(mentions, lambda m: list_contains(s.al, m))), 'told': len(list_filter(mentions, lambda m: list_contains(s.adr, m))), 'named2': len(list_filter(s.al, lambda a: strlen(a) >= 3 AND contains(low, a))), 'told2': len(list_filter(s.adr, lambda a: NOT list_contains(mentions, a) AND strlen(a) >= 3 AND contains(low, a)))}})"""
_TOTAL = """0.42 * x.c + 0.38 * x.t + 0.2 * x.h + CASE WHEN x.la = actor THEN 0.06 WHEN x.part THEN 0.03 ELSE 0 END + CASE WHEN x.named + x.told > 0 THEN least(2, x.named) * 0.05 + least(2, x.told) * 0.04 ELSE least(2, x.named2) * 0.05 + least(2, x.told2) * 0.04 END
  + CASE WHEN cue AND x.age <= 6 THEN 0.05 * (1 - least(0.85, x.age / 6.0)) ELSE 0 END + 0.04 * x.stab - 0.01 * least(x.age, 32)"""
_NEAR_BY = "NOT {0}.orphan AND greatest(0, turn - {0}.lt) <= 3"
_STEP = _layers(
    "SELECT f.scope_key, x.n, x.turn, x.vec, x.actor, x.alias, x.low, x.mentions, x.cue, x.reaction, streams, nst, nseg, lasta, streak, hold FROM f JOIN rin x ON x.scope_key = f.scope_key AND x.n = f.n + 1",
    f"list_filter(streams, lambda s: {_LIVES}) AS kept, list_filter(streams, lambda s: NOT ({_LIVES})) AS gone",
    f"flatten(list_transform(gone, lambda s: s.pend)) AS lost1, {_HELD} AS held, len(list_filter(kept, lambda s: NOT s.orphan AND NOT s.amb)) AS real, coalesce(list_filter(kept, lambda s: s.amb)[1].id, nst) AS ambient",
    f"list_sort(list_transform(held, lambda x: {{'o': -({_TOTAL}), 'id': x.id, 'lk': greatest(x.t, x.c), 'orphan': x.orphan, 'lt': x.lt, 'stab': x.stab}})) AS ranked",
    "ranked[1] AS b, list_filter(ranked, lambda x: x.id = lasta)[1] AS fr, len(ranked) AS k",
    "CASE WHEN k > 0 THEN -b.o ELSE -1.0 END AS best, CASE WHEN k > 1 THEN -ranked[2].o ELSE -1.0 END AS second",
    f"""CASE WHEN k > 0 AND best >= 0.8 THEN 'assign' WHEN k > 0 AND reaction AND {_NEAR_BY.format('b')} AND best >= 0.46 THEN 'attach_reaction'
  WHEN k > 0 AND reaction AND fr.id IS NOT NULL AND {_NEAR_BY.format('fr')} AND (-fr.o >= 0.36 OR fr.stab >= 0.18) THEN 'attach_recent' WHEN reaction AND real > 0 THEN 'ambient'
  WHEN k > 0 AND best >= 0.72 AND ((k > 1 AND best - second < 0.06) OR real >= 6) THEN 'keep_pending' WHEN real < 6 THEN 'create' ELSE 'orphan' END AS how""",
    "CASE WHEN how IN ('assign', 'attach_reaction', 'keep_pending') THEN b.id WHEN how = 'attach_recent' THEN fr.id WHEN how = 'ambient' THEN ambient ELSE nst END AS tid, how IN ('ambient', 'keep_pending', 'orphan') AS aside, how = 'assign' AND b.lk < 0.62 AS renew",
    """tid = nst AS opens, CASE how WHEN 'assign' THEN 'attach' WHEN 'attach_reaction' THEN 'attach' WHEN 'attach_recent' THEN 'attach' WHEN 'create' THEN 'open' ELSE how END AS decision,
  CASE WHEN renew THEN 'reset_topic' WHEN how = 'assign' AND b.orphan THEN 'promote_orphan' WHEN how = 'ambient' THEN 'ambient_attach' WHEN how = 'orphan' THEN 'orphan_overflow' ELSE how END AS why,
  CASE how WHEN 'assign' THEN best WHEN 'keep_pending' THEN best WHEN 'create' THEN 1.0 WHEN 'attach_reaction' THEN least(1.25, greatest(0.0, best + 0.04)) WHEN 'attach_recent' THEN least(1.25, greatest(0.0, 0.04 - fr.o)) ELSE greatest(0.0, best) END AS confidence""",
    f"""list_concat({_with(_with('kept', 'renew AND s.id = tid', seg='nseg', **_NEW), orphan="s.orphan AND NOT (how = 'assign' AND s.id = tid)")},
  list_filter([{{'id': nst, 'seg': nseg, 'win': [vec], 'cen': vec, 'head': vec, 'tail': vec, 'lt': turn, 'la': actor, 'conf': 0, 'sure': 0.0, 'parts': []::VARCHAR[], 'al': []::VARCHAR[], 'adr': []::VARCHAR[], 'pend': []::{_EVENTS}, 'loc': []::{_EVENTS}, 'orphan': how = 'orphan', 'amb': how = 'ambient'}}], lambda s: opens)) AS st1,
  nseg + (opens OR renew)::INT AS nseg1, nst + opens::INT AS nst1, CASE WHEN aside THEN 0 WHEN lasta = tid THEN streak + 1 ELSE 1 END AS streak1, CASE WHEN aside THEN lasta ELSE tid END AS lasta1""",
    "len(list_filter(st1, lambda s: NOT s.orphan AND NOT s.amb)) > 1 AS several0",
    "several0 AND streak1 >= 4 AND len(list_filter(st1, lambda s: s.id <> tid AND turn - s.lt < 8)) = 0 AS merged",
    f"""CASE WHEN merged THEN list_concat(lost1, flatten(list_transform(list_filter(st1, lambda s: s.id <> tid), lambda s: s.pend))) ELSE lost1 END AS lost2, {_with("list_filter(st1, lambda s: NOT merged OR s.id = tid)", 'merged', seg='nseg1', **_NEW)} AS st2,
  nseg1 + merged::INT AS nseg2, CASE WHEN merged THEN 1 ELSE streak1 END AS streak2, several0 AND NOT merged AS several, renew OR merged AS boundary, CASE WHEN merged THEN 'merge' ELSE why END AS reason""",
    "CASE WHEN several THEN greatest(hold, turn + 8) WHEN boundary THEN greatest(hold, turn + 2) ELSE hold END AS hold1, list_filter(st2, lambda s: s.id = tid)[1] AS tg",
    "aside OR several OR turn <= hold1 AS local_sequence, scope_key || '$th:' || tid AS thread_key, scope_key || '$th:' || tid || '/seg:' || tg.seg AS segment_key, NOT (aside AND NOT tg.orphan AND NOT tg.amb) AS learns, CASE WHEN opens OR boundary THEN tg.win ELSE list_append(tg.win, vec)[-4:] END AS win1",
    f"{sql_mean('win1')} AS cen1",
    _with("st2", "learns AND s.id = tid", win="win1", cen="cen1", tail="vec", lt="turn", la="actor", conf="s.conf + (NOT aside)::INT", sure="0.75 * s.sure + 0.25 * confidence", parts="CASE WHEN list_contains(s.parts, actor) THEN s.parts ELSE list_append(s.parts, actor) END",
          al="CASE WHEN list_contains(s.al, alias) THEN s.al ELSE list_append(s.al, alias) END", adr="list_concat(s.adr, list_filter(mentions, lambda m: NOT list_contains(s.adr, m)))") + " AS st3",
    "list_transform(st3, lambda s: CASE WHEN s.id <> tid OR boundary THEN greatest(0, len(s.pend) - CASE WHEN turn - s.lt >= 2 OR s.id = tid THEN 0 ELSE 1 END) ELSE 0 END) AS cuts, {'turn': turn, 'tk': thread_key, 'sk': segment_key} AS event, list_position(list_transform(st3, lambda s: s.id), tid) AS ti",
    "list_concat(lost2, flatten(list_transform(st3, lambda s, i: s.pend[:cuts[i]]))) AS out1, list_transform(st3, lambda s, i: s.pend[cuts[i] + 1:]) AS pend1",
    "CASE WHEN aside THEN pend1[ti] ELSE list_append(list_concat(pend1[ti], list_transform(st3[ti].loc, lambda e: {'turn': e.turn, 'tk': thread_key, 'sk': segment_key})), event) END AS full1",
    "CASE WHEN aside THEN 0 WHEN local_sequence THEN len(full1) - 1 WHEN len(full1) >= 2 THEN len(full1) ELSE 0 END AS cut1",
    "list_concat(out1, full1[:cut1]) AS out, " + _with("st3", pend="CASE WHEN s.id = tid THEN full1[cut1 + 1:] ELSE pend1[list_position(list_transform(st3, lambda z: z.id), s.id)] END",
          loc="CASE WHEN s.id <> tid THEN s.loc WHEN aside AND s.amb THEN list_append(s.loc, event)[-12:] WHEN aside THEN list_append(s.loc, event)[-4:] ELSE s.loc[:0] END", lt="CASE WHEN s.id = tid AND aside THEN turn ELSE s.lt END") + " AS st4",
)
def router_sql(src: str = "turns", chatty: bool = True) -> str:
    """The machine over ``src`` as ``rt``, what it has settled as ``com``, its last states as ``fin`` and its scores as ``rs``."""
    return f"""rin0 AS (SELECT turn, source || ':' || room_id AS scope_key, vec, source || '/room:' || room_id || '/uid:' || user_id AS actor, lower(user_id) AS alias, CASE WHEN {chatty} AND turn % 4 = 2 THEN ({list(CHAT)!r})[(turn // 4) % {len(CHAT)} + 1] ELSE user_input END AS text FROM {src}),
rin AS (SELECT *, lower(text) AS low, list_filter(list_distinct(list_transform(regexp_extract_all(text, '{_MENTION}', 1), lambda a: regexp_replace(lower(a), '^[@#]+', ''))), lambda a: a <> '') AS mentions, {_CUE} AS cue, {_REACTION} AS reaction, row_number() OVER (PARTITION BY scope_key ORDER BY turn) AS n FROM rin0),
rt AS MATERIALIZED (WITH RECURSIVE f AS (
  SELECT DISTINCT scope_key, 0::BIGINT AS n, 0::BIGINT AS turn, '' AS decision, '' AS reason, 0 AS stream, '' AS thread_key, '' AS segment_key, 0.0::DOUBLE AS confidence, 0.0::DOUBLE AS best, 0.0::DOUBLE AS second, false AS pending_only, false AS boundary, false AS merged, false AS local_sequence, false AS several, []::{_EVENTS} AS settled,
    []::STRUCT(o DOUBLE, id INT, lk DOUBLE, orphan BOOLEAN, lt BIGINT, stab DOUBLE)[] AS ranked, []::{_STREAM} AS streams, 1 AS nst, 1 AS nseg, 0 AS lasta, 0 AS streak, 0::BIGINT AS hold FROM rin
  UNION ALL
  SELECT scope_key, n, turn, decision, reason, tid, thread_key, segment_key, confidence, best, second, aside, boundary, merged, local_sequence, several, out, ranked, st4, nst1, nseg2, lasta1, streak2, hold1 FROM ({_STEP}))
  SELECT * FROM f WHERE n > 0),
fin AS (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY n DESC) = 1),
com AS MATERIALIZED (SELECT scope_key, e.turn AS turn, at_turn, e.tk AS thread_key, e.sk AS segment_key FROM (SELECT scope_key, turn AS at_turn, unnest(settled) AS e FROM rt UNION ALL SELECT scope_key, 0, unnest(flatten(list_transform(streams, lambda s: s.pend))) FROM fin)),
rs AS (SELECT scope_key, turn, r.id::BIGINT AS stream, n AS rank, -r.o AS score, r.lk AS likeness, r.stab AS stability FROM (SELECT scope_key, turn, unnest(ranked) AS r, unnest(range(1, len(ranked) + 1)) AS n FROM rt))"""


_R = f"{_T}, {router_sql()}"


@query("r0_enabled", f"{_T} SELECT turn, source IN ('bilibili') AS routed FROM turns")
def r0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("turn", F.col("source").isin(*DEFAULT.router.sources).alias("routed"))


@query("r1_stability", f"{_R} SELECT scope_key, turn, stream, round(stability, 6) AS stability FROM rs")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How settled each stream was when a message came."""
    return scores(chat(turns(spark, sf_dir))).select("scope_key", "turn", "stream", F.round("stability", 6).alias("stability"))


@query("r2_stream_score", f"{_R} SELECT scope_key, turn, stream, round(score, 6) AS score, round(likeness, 6) AS likeness FROM rs")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(chat(turns(spark, sf_dir))).select("scope_key", "turn", "stream", F.round("score", 6).alias("score"), F.round("likeness", 6).alias("likeness"))


@query("r3_best_second", f"{_R} SELECT scope_key, turn, max(stream) FILTER (WHERE rank = 1) AS best, round(max(score) FILTER (WHERE rank = 1), 6) AS score, round(max(score) FILTER (WHERE rank = 1) - coalesce(max(score) FILTER (WHERE rank = 2), -1), 6) AS margin FROM rs GROUP BY ALL")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(chat(turns(spark, sf_dir))).where("rank <= 2")
    top, nxt = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    return s.groupBy("scope_key", "turn").agg(F.max(F.when(F.col("rank") == 1, F.col("stream"))).alias("best"), F.round(top, 6).alias("score"), F.round(top - F.coalesce(nxt, F.lit(-1.0)), 6).alias("margin"))


@query("r4_reactions", f"{_R} SELECT scope_key, turn, reason, stream::BIGINT AS stream FROM rt WHERE reason IN ('attach_reaction', 'attach_recent', 'ambient_attach')")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("kind = 'routed' and reason in ('attach_reaction', 'attach_recent', 'ambient_attach')").select("scope_key", "turn", "reason", "stream")


@query("r5_route", f"{_R} SELECT scope_key, turn, decision, reason, thread_key, round(confidence, 5) AS confidence, round(best, 5) AS best, round(second, 5) AS second, pending_only FROM rt")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(spark, sf_dir).where("kind = 'routed'")
    return r.select("scope_key", "turn", "decision", "reason", "thread_key", *[F.round(x, 5).alias(x) for x in ("confidence", "best", "second")], "pending_only")


@query("r6_keys", f"{_R} SELECT scope_key, thread_key, segment_key, min(turn) AS first_turn, count(*) AS messages FROM rt GROUP BY ALL")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads and segments that were opened, with their first turns."""
    r = _routed(spark, sf_dir).where("kind = 'routed' and thread_key <> ''")
    return r.groupBy("scope_key", "thread_key", "segment_key").agg(F.min("turn").alias("first_turn"), F.count("*").alias("messages"))


@query("r7_merges", f"{_R} SELECT scope_key, turn, thread_key, segment_key FROM rt WHERE merged")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("merged").select("scope_key", "turn", "thread_key", "segment_key")


@query("r8_local_sequence", f"{_R} SELECT scope_key, turn, CASE WHEN several THEN 'split' ELSE 'single' END AS mode, local_sequence FROM rt")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("kind = 'routed'").select("scope_key", "turn", "mode", "local_sequence")


@query("r9_lifetimes", f"{_R} SELECT scope_key, thread_key, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS messages FROM rt GROUP BY ALL")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last turn of each thread; idle ones are evicted, so a later message opens another."""
    r = _routed(spark, sf_dir).where("kind = 'routed' and thread_key <> ''")
    return r.groupBy("scope_key", "thread_key").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("messages"))


_W4 = "w4 AS (SELECT a.turn, p, avg(b.vec[p]) AS x FROM (SELECT turn, anchor, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS n FROM mem) a JOIN (SELECT anchor, vec, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS n FROM mem) b ON a.anchor = b.anchor AND b.n BETWEEN a.n - 3 AND a.n, range(1, 65) r(p) GROUP BY ALL)"


@query("r10_window_centroid", f"{_T}, {MEMORIES}, {_W4}, c4 AS (SELECT turn, list(x ORDER BY p) AS v FROM w4 GROUP BY 1) SELECT turn, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM c4")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last four vectors of the stream, by a sliding frame."""
    w = Window.partitionBy("anchor").orderBy("turn").rowsBetween(-3, 0)
    m = memories(turns(spark, sf_dir)).withColumn("w", F.collect_list("vec").over(w))
    first = F.transform(F.col("w")[0], lambda x: F.lit(0.0))
    total = F.aggregate("w", first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    m = m.select("turn", F.transform(total, lambda x: x / F.size("w")).alias("v"))
    return m.select("turn", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("r11_committed", f"{_R} SELECT scope_key, turn, at_turn, thread_key, segment_key FROM com")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every settled event with the turn that settled it; 0 stands for the final flush."""
    return _routed(spark, sf_dir).where("kind = 'committed'").select("scope_key", "turn", "at_turn", "thread_key", "segment_key")


def pending_context(held: DataFrame, t: DataFrame, cfg: Settings = DEFAULT.router) -> DataFrame:
    """scope_key, pending: the last events of each scope that the router still holds, as they are shown."""
    from .retrieval import excerpt

    n = F.row_number().over(Window.partitionBy("scope_key").orderBy(F.col("turn").desc(), F.col("thread_key").desc()))
    h = held.withColumn("n", n).where(F.col("n") <= cfg.pending_context).join(t.select("turn", "user_input"), "turn")
    line = F.concat(F.lit("第"), F.col("turn").cast("string"), F.lit("轮 用户："), excerpt(F.col("user_input"), 140))
    return h.groupBy("scope_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]), "\n").alias("pending"))


_PENDING = "hd AS (SELECT scope_key, e.turn AS turn, e.tk AS tk FROM (SELECT scope_key, unnest(flatten(list_transform(streams, lambda s: list_concat(s.pend, s.loc)))) AS e FROM fin)), hp AS (SELECT scope_key, string_agg('第' || hd.turn || '轮 用户：' || CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '...' ELSE text END, chr(10) ORDER BY hd.turn) AS pending FROM (SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY turn DESC, tk DESC) <= 2) hd JOIN rin USING (scope_key, turn) GROUP BY 1)"


@query("r12_pending_context", f"{_R}, {_PENDING} SELECT scope_key, pending FROM hp")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two events of each scope that are not settled after its last message."""
    t = chat(turns(spark, sf_dir))
    return pending_context(route(t).where("kind = 'held'"), t)


@query("r13_flush", f"{_R} SELECT scope_key, turn, thread_key FROM com WHERE at_turn = 0")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the final flush settles; messages kept aside that no later one took along stay out."""
    return _routed(spark, sf_dir).where("kind = 'committed' and at_turn = 0").select("scope_key", "turn", "thread_key")


@query("r14_state", f"{_R}, x AS (SELECT scope_key, nst, nseg, unnest(streams) AS s FROM fin) SELECT scope_key, nst::BIGINT AS next_stream, nseg::BIGINT AS next_segment, s.id::BIGINT AS stream, s.seg::BIGINT AS segment, s.conf::BIGINT AS confirmed, len(s.pend) AS pending, len(s.loc) AS kept_aside FROM x")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each scope after its last message, as plain data."""

    def step(r: Router, row: dict) -> list[tuple]:
        route_step(r, row)
        return []

    schema = "scope_key string, next_stream long, next_segment long, stream long, segment long, confirmed long, pending long, kept_aside long"
    return keyed_fold(router_input(chat(turns(spark, sf_dir))), "scope_key", ["turn"], Router, step, schema, Router.export)


__all__ = ["Router", "route", "route_step"]
