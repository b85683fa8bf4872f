"""Settings of the operators, one frozen class a module; every operator takes one."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Guard:
    default_credit: float = 1.0
    live_credit: float = 0.35
    live_sources: tuple[str, ...] = ("bilibili",)
    decay: float = 0.985
    bonus: float = 0.02
    penalty: float = 0.40
    clean_risk: float = 0.05
    note_below: float = 0.65
    note_change: float = 0.12
    note_risk: float = 0.60
    block_below: float = 0.25
    block_seconds: int = 3600
    restore_at: float = 0.75
    recall_at: float = 0.70
    history_at: float = 0.70
    topic_at: float = 0.60
    write_at: float = 0.75
    max_users: int = 2048
    scope_strategy: str = "source_room"


@dataclass(frozen=True)
class Topic:
    head: int = 4
    tail: int = 3
    drift: float = 0.62
    break_at: float = 0.48
    confirm: float = 0.55
    min_length: int = 2
    fingerprint_top: int = 3
    chain_top: int = 3
    chain_min: float = 0.20


@dataclass(frozen=True)
class Graph:
    transition: float = 0.12
    recall: float = 0.10
    adopt: float = 0.18
    decay: float = 0.995
    edge_cap: float = 8.0
    prune_below: float = 1e-4
    prior_cap: int = 64
    next_cap: int = 32
    flow_ttl: int = 128
    flow_cap: int = 256
    merge_at: float = 0.95


@dataclass(frozen=True)
class Activation:
    decay: float = 0.985
    most: float = 8.0
    bind: float = 1.0
    recall: float = 0.10
    adopt: float = 0.18
    open_at: float = 0.25
    close_below: float = 0.12
    windows_cap: int = 128
    prior_weight: float = 0.08
    prior_most: float = 0.10
    prior_gate: float = 0.35
    recency: float = 64.0
    closed_factor: float = 0.60


@dataclass(frozen=True)
class Art:
    category_at: float = 0.88
    category_beta: float = 0.28
    bundle_at: float = 0.82
    bundle_beta: float = 0.18
    exemplars: int = 12
    categories: int = 4
    bundles: int = 2
    bundle_margin: float = 0.06
    neighbours: int = 2
    prior_weight: float = 0.18
    recall_lr: float = 0.10
    adopt_lr: float = 0.18
    edge_lr: float = 0.14
    decay: float = 0.996
    prior_cap: float = 4.0
    link_floor: float = 0.02


@dataclass(frozen=True)
class Router:
    sources: tuple[str, ...] = ("bilibili",)
    max_streams: int = 6
    window: int = 4
    assign: float = 0.80
    pending: float = 0.72
    margin: float = 0.06
    reset: float = 0.62
    same_actor: float = 0.06
    participant: float = 0.03
    explicit: float = 0.05
    addressee: float = 0.04
    cue: float = 0.05
    cue_recent: int = 6
    w_centroid: float = 0.42
    w_tail: float = 0.38
    w_head: float = 0.20
    stability: float = 0.04
    stability_turns: int = 4
    age: float = 0.01
    age_cap: int = 32
    stale: int = 60
    orphan_stale: int = 20
    reaction_at: float = 0.46
    recent_at: float = 0.36
    recent_stability: float = 0.18
    recent_turns: int = 3
    local_cap: int = 4
    ambient_cap: int = 12
    commit_idle: int = 2
    commit_chunk: int = 2
    pending_context: int = 2
    merge_idle: int = 8
    merge_streak: int = 4
    hold: int = 8


@dataclass(frozen=True)
class Retrieval:
    seed_topics: int = 2
    return_topics: int = 4
    per_topic: int = 3
    loaded_cap: int = 24
    load_budget: int = 4
    bridge_topk: int = 8
    bridge_hops: int = 2
    bridge_min: float = 0.08
    bridge_weight: float = 0.55
    bridge_keep: float = 0.60
    resident_bonus: float = 0.08
    current_bonus: float = 0.12
    family_at: float = 0.84
    facet_slots: int = 6
    saturation: float = 0.95
    max_memories: int = 8
    max_turns: int = 10
    recent_weight: float = 0.55
    transcript_turns: int = 6
    user_chars: int = 180
    assistant_chars: int = 220


@dataclass(frozen=True)
class Config:
    guard: Guard = field(default_factory=Guard)
    topic: Topic = field(default_factory=Topic)
    graph: Graph = field(default_factory=Graph)
    activation: Activation = field(default_factory=Activation)
    art: Art = field(default_factory=Art)
    router: Router = field(default_factory=Router)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def get(self, path: str, default=None):
        """A setting by its dotted path."""
        at = asdict(self)
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def with_values(self, module: str, **values) -> Config:
        return replace(self, **{module: replace(getattr(self, module), **values)})


DEFAULT = Config()
