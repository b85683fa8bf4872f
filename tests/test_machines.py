"""The keyed machines on small inputs, and what must hold of any run."""

from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.api import Memory
from threadloom.config import DEFAULT
from threadloom.operators import vectors
from threadloom.operators.art import Map, Prior, art_step, reinforce_step
from threadloom.operators.graph import Active, _drain, activation_step
from threadloom.operators.guard import TRUSTED, Credit, admissions, credit_step, credits
from threadloom.operators.memory import Store, merge_step
from threadloom.operators.evaluation import report, simulate
from threadloom.operators.retrieval import Store as RecallStore
from threadloom.operators.retrieval import pick, pick_topics
from threadloom.operators.router import Router, route, route_step
from threadloom.operators.segments import Segment, segment_step
from threadloom.operators.vectors import VectorIndex, knn_topk, recall_of
from threadloom.sources.durability import Snapshots, recover
from threadloom.sources.fixtures import memories, split_store, turns


def message(turn, vec, **over):
    return {"turn": turn, "vec": vec, "actor": "a", "alias": "", "low": "hello there", "mentions": [], "cue": False, "reaction": False} | over


def test_live_actors_start_below_every_gate_and_earn_trust():
    s, step = Credit("a"), credit_step(DEFAULT.guard)
    rows = [step(s, {"turn": t, "source": "bilibili", "ts": t, "risk": 0.0})[0] for t in range(1, 41)]
    after = [r[3] for r in rows]
    assert rows[0][2] == 0.35
    assert next(i for i, c in enumerate(after, 1) if c >= 0.70) == 30
    assert next(i for i, c in enumerate(after, 1) if c >= 0.75) == 35


@given(st.lists(st.floats(0, 1), min_size=1, max_size=60))
def test_credit_stays_in_range(risks):
    s, step = Credit("a"), credit_step(DEFAULT.guard)
    for t, r in enumerate(risks, 1):
        assert 0.0 <= step(s, {"turn": t, "source": "chat", "ts": t, "risk": r})[0][3] <= 1.0


def test_low_credit_blocks_for_the_cooldown():
    s, step = Credit("a"), credit_step(DEFAULT.guard)
    for t in range(1, 4):
        row = step(s, {"turn": t, "source": "bilibili", "ts": 100 * t, "risk": 1.0})[0]
    assert row[5] and row[6] == 300 + 3600


def test_segments_split_where_the_vectors_turn():
    a, b = [1.0, 0.0], [0.0, 1.0]
    s, step = Segment(), segment_step(DEFAULT.topic)
    out = [step(s, {"turn": t, "vec": v, "scope_key": "x"})[0] for t, v in enumerate([a, a, a, a, b, b], 1)]
    assert [r[3] for r in out] == [True, False, False, False, True, False]
    assert [r[2] for r in out] == [1, 1, 1, 1, 5, 5]


def test_segments_close_at_another_scope():
    s, step = Segment(), segment_step(DEFAULT.topic)
    out = [step(s, {"turn": t, "vec": [1.0], "scope_key": k})[0][4] for t, k in enumerate("xxy", 1)]
    assert out == ["first", "", "scope"]


@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0.01, 1.0)), min_size=1, max_size=40))
def test_activation_is_bounded_and_windows_do_not_overlap(steps):
    s, step, turn, closed = Active("x"), activation_step(DEFAULT.activation), 0, []
    for gap, amount in steps:
        turn += gap * 20
        for r in step(s, {"turn": turn, "amount": amount, "reason": "bind"}):
            assert 0 <= r[2] <= DEFAULT.activation.most
            if r[-1] == "decay":
                closed.append((r[3], r[4]))
    closed += [(r[3], r[4]) for r in _drain(s)]
    assert all(a[1] < b[0] for a, b in zip(closed, closed[1:], strict=False))


def test_merging_keeps_the_first_writer():
    s, step = Store(), merge_step(DEFAULT.graph)
    out = [step(s, {"mem_id": i, "vec": v})[0] for i, v in ((1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0]))]
    assert out == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 1, True)]


def test_art_makes_categories_by_likeness():
    s, step = Map("t"), art_step(DEFAULT.art)
    out = [step(s, {"turn": t, "mem_id": t, "vec": v})[0] for t, v in enumerate([[1.0, 0.0], [1.0, 0.05], [0.0, 1.0], [1.0, 0.0]], 1)]
    assert [r[3] for r in out] == [1, 1, 2, 1]
    assert [r[4] for r in out] == [1, 1, 2, 1]
    assert out[2][8] == 1 and out[3][8] == 2


@given(st.lists(st.integers(1, 5), min_size=1, max_size=50))
def test_priors_stay_below_one(gaps):
    s, step, t = Prior("k"), reinforce_step(DEFAULT.art), 0
    for g in gaps:
        t += g
        assert 0 <= step(s, {"turn": t, "lr": 0.18})[0][2] <= 1


def test_router_opens_attaches_and_keeps_apart():
    r = Router("s")
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    reasons = [r.route(m).reason for m in (message(1, a),)]
    r.observe(r.route(message(2, a)), message(2, a))
    assert reasons == ["create"]
    assert r.route(message(3, a)).reason == "assign"
    assert r.route(message(4, b)).reason == "create"
    assert r.route(message(5, [])).decision == "drop"


def test_router_overflows_into_an_orphan():
    r = Router("s")
    axes = [[float(i == k) for i in range(9)] for k in range(9)]
    kinds = [r.route(message(t, axes[t - 1])).decision for t in range(1, 8)]
    assert kinds == ["open"] * 6 + ["orphan"]


def test_reactions_attach_to_what_is_recent_and_else_go_aside():
    r = Router("s")
    a, b = [1.0, 0.0], [0.75, 0.661]
    m = message(1, a)
    r.observe(r.route(m), m)
    assert r.route(message(2, b, reaction=True, actor="z")).reason == "attach_reaction"
    assert r.route(message(9, [0.0, 1.0], reaction=True, actor="z")).reason == "ambient_attach"


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 6), st.booleans()), min_size=1, max_size=60))
def test_router_commits_each_event_once(seq):
    r, turn, routed, done = Router("s"), 0, [], []
    for k, gap, small in seq:
        turn += gap
        out = route_step(r, message(turn, [float(i == k) for i in range(5)], reaction=small))
        routed += [x[2] for x in out if x[0] == "routed"]
        done += [x[2] for x in out if x[0] == "committed"]
    done += [e["turn"] for e in r.drain()]
    assert len(done) == len(set(done)) and set(done) <= set(routed)


def chosen(sem, group, cover, want, k, like=None):
    n = len(sem)
    like = np.eye(n) if like is None else np.array(like)
    return pick(np.array(sem), np.full(n, 0.5), np.array(group), like, np.array(cover, float).reshape(n, len(want)), np.array(want), k)[0]


def test_greedy_choice_prefers_what_is_not_covered():
    assert chosen([0.9, 0.88, 0.6], [1, 1, 2], [[1, 0], [1, 0], [0, 1]], [0.5, 0.5], 2) == [0, 2]
    assert chosen([0.9, 0.88, 0.6], [1, 1, 2], [[], [], []], [], 1) == [0]


def test_greedy_choice_passes_over_what_is_all_but_equal():
    twins = [[1, 1, 0], [1, 1, 0], [0, 0, 1]]
    assert chosen([0.9, 0.9, 0.8], [-1, -1, -1], [[], [], []], [], 2, twins) == [0, 2]
    assert chosen([0.9, 0.9, 0.2], [-1, -1, -1], [[], [], []], [], 3, twins) == [0, 1, 2]


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(-1, 3)), min_size=1, max_size=12), st.integers(1, 15))
def test_greedy_choice_takes_each_once(rows, k):
    got = chosen([r[0] for r in rows], [r[1] for r in rows], [[]] * len(rows), [], k)
    assert len(got) == len(set(got)) == min(k, len(rows))


def test_one_topic_of_a_family():
    none = np.zeros((3, 0))
    assert pick_topics(none, np.array([0.9, 0.8, 0.1]), np.array([1, 1, 2]), np.zeros(0), 4)[0] == [0, 2]
    cover = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert pick_topics(cover, np.array([0.5, 0.5, 0.4]), np.array([1, 2, 3]), np.array([0.5, 0.5]), 2)[0] == [0, 2]


def test_simulated_runs_and_their_report(spark):
    """Rooms never meet, nobody sees what is another's own, and most questions find what was said."""
    run = spark.createDataFrame(simulate(spark, 120).collect())
    rows = sorted(report([run, run.withColumn("seed", F.lit(43))]).collect(), key=lambda r: r.seed or 99)
    assert [r.seed for r in rows] == [42, 43, None] and rows[-1].queries == sum(r.queries for r in rows[:2])
    for r in rows:
        assert r.cross_room == 0 and r.cross_actor == 0 and r.found > 0.5 and r.empty < 0.5


def test_a_store_of_frames(spark, data):
    """A store with tables of its own gives what the fixture's gives."""
    plain = RecallStore(*split_store(memories(turns(spark, data))))
    key = lambda df: sorted(map(tuple, df.select("qid", "kind", "n", "anchor", "mem_id", F.round("value", 6)).collect()), key=repr)
    assert key(plain.recalled()) == key(RecallStore.of(spark, data).recalled())


def test_facade_writes_and_reads(spark, data, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m", TRUSTED)
    t = turns(spark, data)
    written = m.ingest(t).count()
    assert written > 0 and m.shutdown() == ["actors", "memories"] and m.shutdown() == []
    assert m.saver.snapshots.load("memories").count() == written
    blocks = m.compile(RecallStore.of(spark, data), t)
    assert {r.kind for r in blocks.select("kind").distinct().collect()} >= {"label", "context", "transcript"}


def test_index_with_more_rows_and_after_loading(spark, tmp_path):
    r = np.random.default_rng(5)
    c = r.normal(size=(12, 16))
    rows = [(i, (c[i % 12] + 0.1 * r.normal(size=16)).tolist()) for i in range(1_500)]
    data = spark.createDataFrame(rows, "id long, v array<double>")
    q = data.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    index = VectorIndex.create(data.where("id < 1000"), k=10)
    index.add(data.where("id >= 1000"))
    assert index.probes < len(index.centroids) / 2 and recall_of(index.search(q, 10), knn_topk(q, data, 10)).first()[0] >= 0.9
    index.save(f"file://{tmp_path}/index")
    again = VectorIndex.load(spark, f"file://{tmp_path}/index")
    key = lambda df: sorted(map(tuple, df.select("qid", "rank", "id").collect()))
    assert key(again.search(q, 10)) == key(index.search(q, 10))


def test_search_by_blocks_equals_the_scan(spark, monkeypatch):
    r = np.random.default_rng(6)
    data = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(600)], "id long, v array<double>")
    q = data.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    key = lambda df: sorted((x.qid, x.rank, x.id, round(x.sim, 9)) for x in df.collect())
    scan = [key(knn_topk(q, data, 5, m, 0.1 if m != "l2" else None)) for m in ("cosine", "l2", "ip")]
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "CHUNK", 100)
    assert [key(knn_topk(q, data, 5, m, 0.1 if m != "l2" else None)) for m in ("cosine", "l2", "ip")] == scan


def test_replay_gives_the_same_rows(spark, data):
    t = turns(spark, data)
    one, two = (sorted(map(tuple, route(x).collect()), key=repr) for x in (t, t.repartition(7)))
    assert one == two


def test_no_thread_crosses_a_scope(spark, data):
    r = route(turns(spark, data)).where("thread_key <> ''")
    assert r.where(~F.col("thread_key").startswith(F.col("scope_key"))).count() == 0


def test_snapshot_pointer_is_swapped_last(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s")
    s.save({"t": spark.range(3)})
    # a version without a pointer, as a crash would leave it
    spark.range(9).write.parquet(f"file://{tmp_path}/s/versions/zzz/t")
    assert s.load("t").count() == 3


def test_recovery_takes_the_later_state(spark):
    cp = spark.createDataFrame([("a", "old", 5), ("b", "kept", 5)], "scope_key string, state string, seq long")
    log = spark.createDataFrame([("a", "new", 9), ("a", "mid", 7)], "scope_key string, state string, seq long")
    assert {tuple(r) for r in recover(cp, log).collect()} == {("a", "new", 9), ("b", "kept", 5)}


def test_credits_fold_equals_plain_loop(spark, data):
    adm = admissions(turns(spark, data))
    got = {(r.actor_key, r.turn): r.after for r in credits(adm).collect()}
    want, state, step = {}, {}, credit_step(DEFAULT.guard)
    for r in sorted(adm.collect(), key=lambda r: r.turn):
        out = step(state.setdefault(r.actor_key, Credit(r.actor_key)), r.asDict())[0]
        want[r.actor_key, r.turn] = out[3]
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_queries_meet_a_topics_map_in_matrix_products(spark):
    """Many categories asked by many queries: as by brute force, and no step makes a row of each query with each category."""
    import time

    import numpy as np
    from pyspark.sql import functions as F

    from threadloom.operators import art

    n, rng = 3000, np.random.default_rng(5)
    v = rng.normal(size=(n, 64))
    mem = spark.createDataFrame([(i, "t", x.tolist()) for i, x in enumerate(v)], "mem_id long, anchor string, vec array<double>")
    assigned = mem.select("anchor", F.col("mem_id").alias("turn"), "mem_id", (F.col("mem_id") + 1).alias("category"), (F.col("mem_id") + 1).alias("bundle"), F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("linked_from"))
    q = mem.select((F.col("mem_id") + n).alias("qid"), "anchor", F.transform("vec", lambda x: -x).alias("qv"))
    began = time.time()
    got = art.candidates(q, mem, assigned, art.bundle_links(assigned)).collect()
    took = time.time() - began
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = np.argsort(-np.round(-u @ u.T, 9), axis=1, kind="stable")[:, :4]
    assert {(r["qid"] - n, r["mem_id"]) for r in got} == {(i, int(j)) for i, row in enumerate(best) for j in row}
    assert {r["route"] for r in got} == {"category"} and all(abs(r["sim"] + float(u[r["qid"] - n] @ u[r["mem_id"]])) < 1e-9 for r in got)
    assert took < 60, took


def test_the_segment_table_keeps_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    import math

    import duckdb

    from threadloom import catalog

    spark.range(300).selectExpr("id as vec_id", "array_repeat(float(-1e-6), 63) || array(float(1)) as embedding", "0 as label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(3).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'hello' as text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sql = con.execute(catalog.oracles()["s9_segment_table"]).fetchall()
    got = catalog.queries()["s9_segment_table"](spark, str(tmp_path)).collect()
    signs = lambda rows: sorted([(r[0], [math.copysign(1, x) for x in r[4]]) for r in rows])
    assert sql and signs(got) == signs(sql) and signs(sql)[0][1][0] == -1


def test_recall_sends_no_vector_with_a_pair_of_query_and_memory(spark):
    """Queries that see none of a topic's nearest memories look it through in whole, where its memories are."""
    import numpy as np
    from pyspark.sql import functions as F

    from threadloom.operators.retrieval import Store

    n, rng = 600, np.random.default_rng(3)
    near = np.eye(64)[0] + 0.4 * rng.normal(size=(n, 64)) / 8
    v = np.where(np.arange(n)[:, None] < n // 2, near, rng.normal(size=(n, 64)))
    kinds = ["actor" if i < n // 2 else "scope" for i in range(n)]
    rows = [(i + 1, "s", "a" if i < n else "b", "t", kinds[i % n], "s|S:1", 1, [i + 1], f"word{i % 7}", (v[i] if i < n else near[i - n]).tolist(), 0, i + 1) for i in range(2 * n)]
    every = spark.createDataFrame(rows, "mem_id long, scope_key string, actor_key string, thread_key string, memory_scope string, anchor string, cluster_id long, turns array<long>, text string, vec array<double>, topic long, turn long")
    sent = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = sent()
    found = Store(every.where(F.col("turn") <= n), every.where(F.col("turn") > n)).recalled().where("kind = 'evidence'").collect()
    assert len(found) == 3 * n and min(r["mem_id"] for r in found) > n // 2
    assert sent() - before < 40e6, sent() - before


def test_values_of_many_pools_are_those_of_each():
    import numpy as np

    from threadloom.operators.retrieval import pick_all

    rng, k, n = np.random.default_rng(1), 6, np.array([5, 0, 9, 1, 7])
    sem, loc, group = rng.random((5, 9)), rng.random((5, 9)), rng.integers(-1, 3, (5, 9))
    units = rng.normal(size=(5, 9, 4))
    units /= np.linalg.norm(units, axis=2, keepdims=True)
    units[2, 1] = units[2, 0]
    cover, want, asked = rng.random((5, 9, k)), rng.random((5, k)), np.array([True, True, False, False, True])
    want[~asked] = 0
    got = pick_all(sem, loc, group, units, cover, want, asked, n)
    for i, m in enumerate(n):
        w = want[i] if asked[i] else np.zeros(0)
        order, values = pick(sem[i, :m], loc[i, :m], group[i, :m], units[i, :m] @ units[i, :m].T, cover[i, :m, : len(w)], w, 48)
        assert np.allclose(got[i, order], values, atol=1e-9) and not got[i, m:].any()


def test_few_rows_give_the_choice_of_the_whole_pool():
    import numpy as np

    from threadloom.operators.retrieval import FIRST_TRIED, _Likeness, pick, pick_few

    rng = np.random.default_rng(5)
    for case in range(40):
        n, w = int(rng.integers(1, 30 * FIRST_TRIED)), int(rng.integers(0, 4))
        units = rng.normal(size=(n, 8))
        # every third case is of rows that are all but equal, so that the first tried don't suffice
        units = units * 0.01 + 1 if case % 3 == 0 else units
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        sem = np.maximum(0, units @ units[0])
        loc, group, want = sem / sem.max(), rng.integers(-1, 4, n), rng.random(w)
        cover = np.where(rng.random((n, w)) < 0.05, rng.random((n, w)), 0.0)
        gain = cover @ want / max(1e-6, want.sum())
        looked = []

        def parts(at, group=group, units=units, cover=cover, want=want, looked=looked):
            looked.append(len(at))
            return group[at], units[at], cover[at], want

        got, values = pick_few(sem, loc, gain, bool(w), 3, parts)
        best, worth = pick(sem, loc, group, _Likeness(units), cover, want, 3)
        assert got == best and np.allclose(values, worth, atol=1e-8)
        assert looked[0] <= max(FIRST_TRIED, 1)


def test_blocks_of_few_topics_are_dealt_among_many_tasks(spark):
    from pyspark.sql import functions as F

    from threadloom.operators.art import DEALT, topic_blocks

    q = spark.range(40).select(F.col("id").alias("qid"), F.concat(F.lit("t"), F.col("id") % 5).alias("anchor"))
    rows = spark.range(5).select(F.concat(F.lit("t"), "id").alias("anchor"), F.col("id").alias("a"))
    got = topic_blocks(q, rows).applyInArrow(lambda left, right: left.select(["qid"]), "qid long")
    assert got.rdd.getNumPartitions() >= DEALT
    assert sorted(x.qid for x in got.collect()) == list(range(40))


def test_routes_fold_a_topics_map_once(spark, data):
    """What reads the map several times reads it from a table."""
    from threadloom import catalog

    plan = catalog.queries()["a5_category_route"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 1, plan.count("MapInArrow")


def test_queries_without_a_bundle_are_told_alike_alone(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from threadloom.operators import art

    n, rng = 400, np.random.default_rng(7)
    v = rng.normal(size=(n, 64))
    mem = spark.createDataFrame([(i, "t", i, x.tolist()) for i, x in enumerate(v)], "mem_id long, anchor string, turn long, vec array<double>")
    ask = [(i, "t", (v[i] if i % 2 else -v[i]).tolist()) for i in range(n)] + [(n, "t", None), (n + 1, "t", [0.0] * 64), (n + 2, "t", [1.0]), (n + 3, "none", v[0].tolist())]
    q = spark.createDataFrame(ask, "qid long, anchor string, qv array<double>")
    assigned = art.art_map(mem)
    every = art.candidates(q, mem, assigned, art.bundle_links(assigned))
    told = {r["route"] for r in every.collect()}
    alone = art.candidates(q, mem, assigned, art.bundle_links(assigned), lost_only=True)
    assert told == {"bundle", "category"} and sorted(alone.collect()) == sorted(every.where(F.col("route") == "category").collect())


def test_what_is_visible_is_counted_without_pairs(spark, tmp_path):
    """Rows that joins give grow with the turns, not with conversations times memories of a scope."""
    import duckdb

    from threadloom import catalog

    n = 400
    spark.range(300).selectExpr("id as vec_id", "array_repeat(float(1), 64) as embedding", "0 as label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(4 * n).selectExpr(f"id % {n} as conv_id", f"id div {n} as turn", "'user' as role", "'hello' as text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    turns(spark, str(tmp_path)).count()

    def nodes(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return nodes(p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan())
        return [p, *(x for i in range(p.children().size()) for x in nodes(p.children().apply(i)))]

    found = catalog.queries()["m5_visible"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.oracles()["m5_visible"]).fetchall())
    rows = [p.metrics().apply("numOutputRows").value() for p in nodes(found._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName()]
    assert rows and sum(rows) <= 4 * 4 * n, rows


def test_counts_of_what_is_visible_agree_with_pairs(spark):
    from threadloom.operators.memory import count_visible, visible

    keys = [(s, t, a) for s in ("s1", "s2", None) for t in ("t1", "t2", None) for a in ("a1", "a2", None)]
    mem = spark.createDataFrame([(*k, m) for i, k in enumerate(keys) for m in ("thread", "actor", "scope", "other", None)[i % 3 :]], "scope_key string, thread_key string, actor_key string, memory_scope string")
    who = spark.createDataFrame([(i, *k) for i, k in enumerate([*keys, keys[0], ("s3", "t1", "a1")])], "id long, scope_key string, thread_key string, actor_key string")
    m, w = mem.select(F.struct("*").alias("m")), who.select("id", F.struct("*").alias("w"))
    pairs = w.join(m, visible(F.col("m"), F.col("w"))).groupBy("id").agg(F.count("*").alias("seen")).collect()
    assert sorted(count_visible(mem, who).select("id", "seen").collect()) == sorted(pairs) and len(pairs) == 19
