"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, decontam, hpylm, knn, mixing, neardup, pii, quality, queries, scratch, substrings, suffix, tokencount
from threadloom.llm.words import Memo

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = ("k", "v", "c", "size", "rep", "key", "row", "votes", "bands", "shard", "pos", "mark", "target", "quality", "email", "pii_all", "at", "spans", "chunk")


def frame(spark, rows):
    """Documents, with clashing columns added."""
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def words(n, seed=0, alphabet="abcdefghijklmnop"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    base = words(120, 1)
    long = words(30_000, 2)
    return frame(spark, [(1, None, None), (2, "", "a"), (3, "   \n\t", "a"), (4, "one", "b"), (5, "one", None), (6, base, "a"), (6, base, "a"), (7, base, "b"), (None, base, "b"), (8, long, "c"), (9, "x" * 50_000, "c"), (10, "é" * 300 + " 你好 " + base[:50], "é")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def documents(spark, data):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


# 1. exact top-k search


def brute_knn(rows, k=10):
    """Repeated ids are rows of their own; short vectors count as padded with zeros."""
    fine = [(n, i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, _, v in fine), default=0)
    fine = [(n, i, np.append(v, np.zeros(dim - len(v), np.int64))) for n, i, v in fine]
    out = collections.Counter()
    for n, i, q in fine:
        if i % 100 == 0:
            best = sorted((-int(q @ x), j) for m, j, x in fine if m != n)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


def test_knn_equals_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    got = collections.Counter(tuple(r) for r in knn.top_k(df).collect())
    assert got == brute_knn([(r.vec_id, r.embedding) for r in df.collect()])


def test_knn_ties_nulls_clusters_and_empty(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centres[i % 5] * (1 + i % 3) + 0.01 * r.normal(size=8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(800, 900)] + [(900, None), (901, []), (902, [1.0, None] * 4), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [1.0] * 8), (1000, [0.5] * 8)]
    rows += [(1000, [0.5] * 8), (1100, [0.25] * 3), (1100, [0.25] * 3), (300, [9.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "block", "chunk", "rank", "row", "floor", "cell", "query")})
    as_float = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    assert collections.Counter(tuple(x) for x in knn.top_k(df).collect()) == brute_knn(as_float)
    assert knn.top_k(df.limit(0)).count() == 0
    assert knn.top_k(df.where("vec_id = 100")).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_knn_sends_only_what_matters(spark, monkeypatch, block):
    """Vectors in clusters: a group gets little more than its own, and the result is that of brute force, whatever the size of a block."""
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "CHUNK", 200)
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[0 if i % 3 == 0 else r.integers(40)] + 0.02 * r.normal(size=32)]) for i in range(6_000)]
    got = knn.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert collections.Counter(tuple(x) for x in got.result.collect()) == brute_knn(rows)
    sent = got.dealt.where("not asks").select("grp", "row").distinct().count()
    assert got.groups >= 3 and sent < 2 * len(rows) and sent < 0.5 * got.groups * len(rows)
    told = got.dealt.where("asks").groupBy("grp", "block", "chunk").count().agg(F.max("count")).first()[0]
    assert told <= 2.5 * block + 10


# 2. token counts

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_equal_the_library(spark, data, edge, empty, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (docs, edge):
        text = [(r.doc_id, r.text or "") for r in df.collect()]
        want = collections.Counter((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in text)
        assert collections.Counter(map(tuple, tokencount.token_counts(df, MODEL).collect())) == want
    assert tokencount.token_counts(empty, MODEL).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b ", "\n", "a\n b\n\n", "  \n x", "▁a ▁", "\x00x", "1234 5", "aaaa" * 60, "　 é́ 你好", "<s> </s>", "\r\n\tx", "the reader's   end"])
def test_every_prefix_is_counted(library, text):
    c = tokencount.counter(MODEL)
    want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    assert c.prefix_counts(text).tolist() == want
    for budget in (0, 1, 3, 10_000):
        assert c.truncate(text, budget) == text[: max(i for i, n in enumerate(want) if n <= budget)]


# 3. quality classifier


def test_classifier_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.classify(docs, train).collect()}
    test = [r for r in labels.where("doc_id % 2 = 1").collect()]
    clean = [r for r in test if r.quality == 1 and r.toxic == 0]
    junk = [r for r in test if r.quality == 0]
    assert sum(got[r.doc_id].kept for r in clean) >= 0.99 * len(clean)
    assert sum(not got[r.doc_id].kept for r in junk) >= 0.95 * len(junk)


def test_classifier_equals_a_plain_version(spark, data):
    """The whole result, from the same models fitted on what plain Python gathers."""
    docs = documents(spark, data)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    said = {i: "".join(map(str, quality.votes(t, Memo(quality.token_code)))) for i, t, _ in docs}
    patterns = sorted(collections.Counter(said.values()).items())
    model = quality.LabelModel([p for p, _ in patterns], [n for _, n in patterns])
    post = dict(zip([p for p, _ in patterns], model.posterior(np.array([[int(c) for c in p] for p, _ in patterns])), strict=True))

    Row = collections.namedtuple("Row", "y dims counts")
    rows = []
    for i, t, _ in docs:
        w = (t or "").split()
        c = collections.Counter(f for x in w for f in quality.features(x))
        c[quality.REPEAT] += 2 * quality.repeats(w)
        dims = sorted(d for d in c if c[d])
        rows.append(Row(float(post[said[i]]), np.array(dims, np.int32).tobytes(), np.array([c[d] for d in dims], np.int32).tobytes()))
    scorer = quality.LinearScorer(sorted(rows))

    known = {}
    for i, t, _ in docs:
        if i in labels:
            known[t] = max(known.get(t, 0.0), float(labels[i]))
    seen = [(y, len((t or "").split()), collections.Counter(f for w in (t or "").split() for f in quality.telling(w))) for t, y in known.items()]
    n, tox = collections.Counter(f for _, _, c in seen for f in c), collections.Counter(f for y, _, c in seen for f in c if y)
    prior, several = sum(y for y, _, _ in seen) / len(seen), sum(1 for f in n if n[f] > 1)

    def tells(f):
        p = min(1 - 1e-9, max(1e-9, tox[f] / n[f]))
        return n[f] > 1 and p > prior and p >= 0.5 and n[f] * (p * math.log(p / prior) + (1 - p) * math.log((1 - p) / (1 - prior))) > math.log(several / quality.LUCK)

    Known = collections.namedtuple("Known", "y n f c")
    toxic = quality.ToxicScorer(sorted(Known(y, k, sorted(f for f in c if tells(f)), [c[f] for f in sorted(c) if tells(f)]) for y, k, c in seen))
    got = {r.doc_id: r for r in quality.classify(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))).collect()}
    for i, t, _ in docs:
        w = (t or "").split()
        weights = [(float(scorer.w[a]) + float(scorer.w[b])) / 2 for a, b in map(quality.features, w)]
        z = (sum(weights) + quality.repeats(w) * float(scorer.w[quality.REPEAT])) / (len(w) + quality.repeats(w)) + scorer.b if w else 30.0
        hits = collections.Counter(f for x in w for f in quality.telling(x) if f in toxic.weights)
        bad = bool(hits) and toxic(hits, len(w)) > 0
        assert math.isclose(got[i].quality, 1 / (1 + math.exp(-min(30, max(-30, z)))), rel_tol=1e-5, abs_tol=1e-6) and got[i].toxic == bad and got[i].kept == (got[i].quality >= 0.5 and not bad)


def test_toxic_documents_held_out(spark, data):
    """Half of the labels teach; of the other half most toxic documents are found and clean ones left alone."""
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.toxic for r in quality.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where("doc_id % 2 = 0")).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    toxic, clean = [got[r.doc_id] for r in test if r.toxic == 1], [got[r.doc_id] for r in test if r.toxic == 0]
    assert sum(toxic) >= 0.78 * len(toxic) and sum(clean) <= 0.006 * len(clean)


def test_label_model_finds_accuracies():
    r = random.Random(1)
    votes = collections.Counter()
    for _ in range(20_000):
        good = r.random() < 0.8
        prose = (2 if good else 1) if r.random() < 0.95 else 0
        small = (2 if (r.random() < 0.9) == good else 1) if r.random() < 0.5 else 0
        rest = "".join("1" if not good and r.random() < 0.4 else "0" for _ in range(len(quality.HEURISTICS) - 2))
        votes[f"{prose}{small}{rest}"] += 1
    m = quality.LabelModel(list(votes), list(votes.values()))
    assert abs(m.prior - 0.8) < 0.03
    assert m.accuracy()["prose"] > 0.95 and 0.8 < m.accuracy()["small_words"] < 0.97


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(r.kept for r in got if r.doc_id in (1, 2, 3)) and not any(r.toxic for r in got)
    assert len({(r.quality, r.kept) for r in got if r.doc_id == 6}) == 1 and sum(r.doc_id == 6 for r in got) == 2
    assert next(r for r in got if r.doc_id == 8).kept and 0 <= min(r.quality for r in got) and max(r.quality for r in got) <= 1
    assert quality.classify(empty, labels.limit(0)).count() == 0
    assert quality.ToxicScorer([]).weights == {}


# 4. mixing


def fill(sizes, weights=(3, 1, 2)):
    """Targets by sharing out again until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = total - sum(capped.values())
        out = {s: share * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > 2 * sizes[s]]
        if not over:
            return capped | out
        capped |= {s: 2 * sizes[s] for s in over}


def check_mix(df):
    rows = [r.asDict() for r in df.select("doc_id", "source", "text").collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = fill(dict(sizes))
    mixed = mixing.mix_sources(df, shard_blocks=8).collect()
    per = collections.defaultdict(int)
    taken = collections.Counter()
    by_row = {}
    for m in mixed:
        per[m["row"]] += m["words"]
        taken[m["source"]] += m["words"]
        by_row[m["row"]] = m
        assert m["source_size"] == sizes[m["source"]] and math.isclose(m["target"], want[m["source"]], abs_tol=1e-6)
    assert collections.Counter((m["doc_id"], m["size"]) for m in by_row.values()) == collections.Counter((r["doc_id"], size(r["text"])) for r in rows)
    assert all(per[k] <= 2 * by_row[k]["size"] for k in per)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    return mixed


def test_mix_hits_targets_and_reruns_agree(spark, data, edge, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = check_mix(docs)
    two = mixing.mix_sources(docs.repartition(5), shard_blocks=8).collect()
    key = lambda m: (m["doc_id"], m["pass"], m["words"], m["shard"], m["place"], m["text"])
    assert sorted(map(key, one), key=repr) == sorted(map(key, two), key=repr)
    assert {m["shard"] for m in one if m["words"]} == set(range(max(m["shard"] or 0 for m in one) + 1))
    three = [sorted(map(key, mixing.mix_sources(edge.repartition(n), shard_blocks=8).collect()), key=repr) for n in (1, 7)]
    assert three[0] == three[1]
    check_mix(edge)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_with_many_sources(spark):
    """Every size of source, shares that are reshared many times, and a tree deep enough to be spread."""
    rows = [(i, words(2 + i % 7 + (400 if i % 50 == 0 else 0), i), None if i % 97 == 0 else f"s{i % 83}") for i in range(1_500)]
    mixed = check_mix(frame(spark, rows))
    assert len({m["shard"] for m in mixed}) > 2 ** (mixing.LEVELS - 1)


@pytest.mark.parametrize(("total", "marked", "drawn"), [(10, 4, 5), (100, 3, 50), (1_000, 500, 400), (7, 7, 3), (5, 0, 2), (40, 39, 39), (20_000, 9_000, 10_000)])
def test_draws_are_hypergeometric(spark, total, marked, drawn):
    n = 40_000
    c = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    got = spark.range(n).select(mixing.hypergeometric(*c, mixing._unit(F.lit(5), F.col("id"))).alias("x")).groupBy("x").count().collect()
    log = lambda k: math.lgamma(k + 1)
    choose = lambda a, b: log(a) - log(b) - log(a - b)
    law = {x: math.exp(choose(marked, x) + choose(total - marked, drawn - x) - choose(total, drawn)) for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
    assert sum(r["count"] for r in got) == n and all(r.x in law for r in got)
    far = 0.5 * sum(abs(law[x] - {r.x: r["count"] for r in got}.get(x, 0) / n) for x in law)
    assert far < 0.01 + 0.4 * sum(math.sqrt(p * (1 - p) / n) for p in law.values())


def test_mix_writes_the_texts(spark, edge, data, tmp_path):
    """What the shards hold is the documents, whole or cut behind the last word drawn, in shuffled order, with their columns."""
    import corpus_pipeline as cp

    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars"))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id, r.source].append(r)
    mixed = mixing.mix_sources(docs, block_docs=2, shard_blocks=10)
    mixing.write_shards(mixed, f"{tmp_path}/shards")
    got = spark.read.schema(mixed.schema).parquet(f"{tmp_path}/shards").collect()
    assert len(got) == mixed.where("words > 0").count() and len({r.shard for r in got}) > 5
    cut = 0
    for r in got:
        ends = [m.end() for m in word.finditer(r.text)]
        whole = [d for d in texts[r.doc_id, r.source] if d.text and d.text.startswith(r.text) and len(word.findall(d.text)) == r.size and (d.lang, d.n_chars) == (r.other.lang, r.other.n_chars)]
        assert len(ends) == r.words and whole and (r.text == whole[0].text if r.words == r.size else ends[-1] == len(r.text))
        cut += r.words < r.size
    assert 0 < cut <= len({r.source for r in got})
    file = max((tmp_path / "shards").glob("shard=*/*.parquet"), key=lambda f: f.stat().st_size)
    place = [r.place for r in spark.read.parquet(str(file)).collect()]
    assert len(place) > 5 and place == sorted(place)

    by = {(r.doc_id, r.size): 0 for r in queries.op4_mix_sources(spark, data).collect()}
    assert len(by) == spark.read.parquet(f"{data}/documents.parquet").count()
    last = cp.mixture(spark, edge, data)
    assert set(edge.columns) <= set(last.columns) and {"mix_shard", "mix_size", "words"} <= set(last.columns)
    assert all(r.shard == "x" and len(word.findall(r.text)) == r.words > 0 for r in last.collect())


def test_mix_uses_no_python_on_executors(edge):
    plan = mixing.mix_sources(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_blocks_are_split_evenly(spark, data):
    m = mixing.mix_sources(spark.read.parquet(f"{data}/documents.parquet"), block_docs=2, shard_blocks=10).where("shard is not null")
    blocks = m.select("source", "shard", "pass").distinct().groupBy("shard").count().collect()
    assert len(blocks) > 5


# 5. language model


def test_base_scores_counts_and_held_out_gain(spark, data, monkeypatch):
    monkeypatch.setattr(hpylm, "CHUNK_TOKENS", 20_000)
    docs = documents(spark, data)
    got = {r.doc_id: r for r in queries.op5_language_model(spark, data).collect()}
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r, base = got[i], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def one_chunk(docs):
    """The corpus as one chunk, its pairs counted, and the states of all sweeps, driven by the operator's own steps."""
    (row,) = hpylm.chunks(docs.coalesce(1), 10**9).collect()
    c, bits, states, model = hpylm.Chunk(row.asDict()), 5, [], None
    own = np.ones(len(c.keys), np.bool_)
    for sweep in range(hpylm.SWEEPS + 1):
        t = (c.pair_count > 0).astype(np.int64) if model is None else hpylm._seating(c, c.pair_count, *states[-1], sweep)
        asked = hpylm._word_requests(c, t, own, bits)
        told = [hpylm._answer_words(model, sweep)(pa.table([[x] for x in r], names=["bucket", "chunk", "keys", "counts"])).to_pylist()[0] for r in asked]
        facts = {k: sum(r[k] for r in told) for k in ("v", "n", "customers", "root_tables", "ones", "twos")}
        model = hpylm.Model(facts["v"], facts["n"], facts["customers"], facts["root_tables"], hpylm._discount(int((c.pair_count == 1).sum()), int((c.pair_count == 2).sum())), hpylm._discount(facts["ones"], facts["twos"]))
        states.append((hpylm.Stats(c, told, bits), model))
    return c, states


def test_probabilities_of_every_context_add_up(spark, data):
    """The model's own numbers, over all known words and the unknown one, at the parent and behind every context."""
    c, states = one_chunk(spark.read.parquet(f"{data}/documents.parquet"))
    for p, (s, m) in zip(hpylm.sampled(c, c.pair_count, states), states[-hpylm.SAMPLES :], strict=True):
        count = states[0][0].count
        parent, known = m.parent(s), count > 0
        known[-1] = False  # the start is no word
        assert math.isclose(parent[known].sum() + m.unknown(), 1.0, rel_tol=1e-9) and (s.root_tables <= s.customers).all()
        seen = known[c.pair_w]
        inside = np.bincount(c.pair_u[seen], weights=p[seen], minlength=len(c.words))
        rest = 1 - np.bincount(c.pair_u[seen], weights=parent[c.pair_w][seen], minlength=len(c.words))
        context = (count > 0) & (np.bincount(c.pair_u, minlength=len(c.words)) > 0)
        back = (hpylm.THETA + m.discount * s.tables) / (hpylm.THETA + count)
        assert np.allclose((inside + back * rest)[context], 1.0, rtol=1e-9) and context.sum() > 1_000


def test_scores_agree_with_a_plain_sampler(spark, data):
    """Customers seated one at a time in dictionaries, with the same discounts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    got = {r.doc_id: r.score for r in hpylm.score_documents(docs).collect()}
    toks = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    pairs = {i: list(zip(["start", *w[:-1]], w, strict=True)) for i, w in toks.items()}
    train = collections.Counter(x for i, p in pairs.items() if zlib.crc32(str(i).encode()) % 10 for x in p)
    known = {w for _, w in train}
    at = collections.Counter()
    for (u, _), n in train.items():
        at[u] += n
    disc = lambda c: hpylm._discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    d, r, total = disc(train), random.Random(3), collections.defaultdict(float)

    def seats(n, s, dd):
        t = 1
        for i in range(1, n):
            t += r.random() < s / (s + i - dd * t)
        return t

    runs = 2
    for _ in range(runs):
        tables, root, per = dict.fromkeys(train, 1), None, collections.defaultdict(float)
        for sweep in range(hpylm.SWEEPS + 1):
            if sweep:
                tables = {(u, w): seats(n, (hpylm.THETA + d * rest[u]) * p0(w), d) for (u, w), n in train.items()}
            rest, cust = collections.Counter(), collections.Counter()
            for (u, w), t in tables.items():
                rest[u] += t
                cust[w] += t
            root = {w: seats(n, (hpylm.ROOT_THETA + d0 * sum(root.values())) / (len(known) + 1), d0) for w, n in cust.items()} if sweep else dict.fromkeys(cust, 1)
            d0 = disc(cust)
            base, full = (hpylm.ROOT_THETA + d0 * sum(root.values())) / (len(known) + 1), hpylm.ROOT_THETA + sum(cust.values())
            p0 = lambda w, cust=cust, root=root, d0=d0, base=base, full=full: (cust[w] - d0 * root.get(w, 0) + base) / full
            if sweep > hpylm.SWEEPS - hpylm.SAMPLES:
                for u, w in {x for p in pairs.values() for x in p}:
                    n, t = train[u, w], tables.get((u, w), 0)
                    per[u, w] += ((n - d * t + (hpylm.THETA + d * rest[u]) * p0(w)) / (hpylm.THETA + at[u]) if at[u] else p0(w)) / hpylm.SAMPLES
        for i, p in pairs.items():
            total[i] += sum(math.log10(per[x]) for x in p) / runs
    assert all(abs(got[i] - total[i]) < 0.01 * abs(total[i]) + 0.5 for i in pairs) and abs(sum(got.values()) / sum(total.values()) - 1) < 0.003


@pytest.mark.parametrize(("n", "s", "d"), [(2, 1.0, 0.5), (20, 0.3, 0.7), (40, 5.0, 0.2), (200, 0.05, 0.9), (200, 2.0, 0.6), (700, 30.0, 0.8), (700, 0.5, 0.05), (1500, 400.0, 0.5)])
def test_seating_follows_the_restaurant_process(n, s, d):
    """The law of the number of tables against that of the process, which a recursion over customers gives exactly."""
    law = np.zeros(n + 1)
    law[1], t = 1.0, np.arange(n + 1)
    for i in range(1, n):
        p = s / (s + np.maximum(i - d * t, 1e-9))
        law = law * (1 - p) + np.append(0.0, (law * p)[:-1])
    size = 200_000
    got = hpylm.seat(np.full(size, n), np.full(size, s), d, np.arange(1, size + 1, dtype=np.uint64), 1)
    seen = np.bincount(got, minlength=n + 1) / size
    noise = np.sqrt(law * (1 - law) / size).sum() * 0.8
    assert got.min() >= 1 and got.max() <= n and 0.5 * np.abs(seen - law).sum() < 0.02 + noise
    assert abs(got.mean() - (law * t).sum()) < 0.01 * (law * t).sum() + 0.01


def test_seating_of_none_and_of_many():
    assert hpylm.seat(np.array([0, 1, 5000]), np.array([1.0] * 3), 0.5, np.arange(3, dtype=np.uint64), 1)[:2].tolist() == [0, 1]
    big = hpylm.seat(np.full(50, 10**9), np.full(50, 2.0), 0.0, np.arange(50, dtype=np.uint64), 1)
    assert abs(big.mean() - 2 * math.log(10**9)) < 5


def test_chunks_grow_with_the_corpus(monkeypatch):
    class Plan:
        def __init__(self, n):
            self.n = n

        def __getattr__(self, _):
            return lambda: self

        def __str__(self):
            return str(self.n)

    def sized(n):
        return hpylm.chunk_tokens(type("D", (), {"_jdf": Plan(n)}))

    assert sized(10**9) == hpylm.CHUNK_TOKENS and sized(1 << 63) == hpylm.CHUNK_TOKENS
    for n in (10**11, 10**12, 10**13, 10**14):
        rows = (n / 4 / sized(n)) ** 2
        assert rows <= 1.01 * n / 4 / hpylm.ROW_PAIRS * max(1, n / 4 * hpylm.ROW_PAIRS / hpylm.MOST_TOKENS**2)


def test_model_edges(edge, empty):
    got = hpylm.score_documents(edge).collect()
    assert len(got) == edge.count() and all(math.isfinite(r.score) for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and not next(r for r in got if r.doc_id is None).held_out
    assert hpylm.score_documents(empty).count() == 0


# 6. personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


PII_TEXTS = [
    None, "", "a@b.c_x@d.e, x@y.z1.2.3.4 ßü😀 q@w.e +49 (30) 123-45678 4111 1111 1111 1111 999.1.1.1 1.2.3.4.5.6.7.8", "1" * 60_000, "a" * 60_000 + "@", "1-" * 30_000, "a@" + "b." * 20_000 + "c",
    "+1" + "(" * 50_000, "x@y.z " * 2_000, "0" * 16, "😀" * 10 + "4111111111111111", "IBAN GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32; ssn 123-45-6789; 123-45-6780",
]


def test_base_spans_equal_brute_force(spark, data):
    rows = [(i, t) for i, t, _ in documents(spark, data)] + [(-i, t) for i, t in enumerate(PII_TEXTS, 1)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in CLASH})).collect()}
    for i, t in rows:
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if fine(k, m[0])] for k, p in BASE.items()}
        said = ",".join(x for k in BASE for x in found[k])
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*(len(found[k]) for k in BASE), hashlib.sha256(said.encode()).hexdigest())
        assert r.spans.startswith(said)
    assert [x.split(":")[0] for x in got[-12].spans.split(",")].count("iban") == 1
    assert got[-12].spans.count("ssn") == 2


def test_redaction_leaves_the_rest(spark, edge):
    df = frame(spark, [(1, None, None), (2, "write to a@b.co now", "s"), (3, "clean", "s"), (4, "a@b.c1.2.3.4", "s")])
    got = {r.doc_id: r for r in pii.redact(df, df.columns).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [None, "write to <email> now", "clean", "<email>"] or got[4].text.startswith("<email>")
    assert pii.redact(df, df.columns).columns == df.columns
    assert pii.redact(edge, edge.columns).count() == edge.count()


def test_pii_and_chat_use_no_python_on_executors(edge, spark):
    assert not re.search("Python|Arrow|Pandas", pii.digest(edge)._jdf.queryExecution().toString())
    df = spark.createDataFrame([(1, "a", "b")], "id long, prompt string, response string")
    assert not re.search("Python|Arrow|Pandas", chat.digest(chat.render(chat.canonical(df)))._jdf.queryExecution().toString())


# 7. chat


def test_conversations_read_back(spark, data):
    rows = [r.asDict() for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    rows += [{"conv_id": -1, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in queries.op7_chat_format(spark, data).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


HARD = ["", "\\", "\\\\e", "\\e\\l\\b", "<|end|>\n", "<|start|>user<|text|>", "[INST]</s>", "😀<[\\", None]


@pytest.mark.parametrize(
    ("schema", "make"),
    [
        ("id long, messages array<struct<role:string,content:string>>", lambda a, b: (1, [("user", a), ("assistant", b)])),
        ("id long, conversations array<struct<from:string,value:string>>", lambda a, b: (1, [("human", a), ("gpt", b)])),
        ("conv_id long, prompt string, response string, extra int", lambda a, b: (1, a, b, 0)),
        ("conv_id long, instruction string, input string, output string", lambda a, b: (1, a, "", b)),
        ("conv_id long, question string, answer string, turns int", lambda a, b: (1, a, b, 0)),
    ],
)
def test_layouts_become_the_same_turns(spark, schema, make):
    rows = [make(a, b) for a, b in itertools.product(HARD, HARD)]
    df = spark.createDataFrame(rows, schema)
    r = chat.render(chat.canonical(df)).select("formatted", "loss_spans", chat.parse(F.col("formatted")).alias("t")).collect()
    got = sorted([(x.t[0].text, x.t[1].text) for x in r])
    assert got == sorted((a or "", b or "") for a, b in itertools.product(HARD, HARD))
    for x in r:
        (span,) = x.loss_spans
        assert x.t[0].role == "user" and x.t[1].role == "assistant" and "[INST]" not in x.formatted
        assert x.formatted[span.start : span.end].replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\") == x.t[1].text


def test_chat_ids_may_be_text(spark):
    rows = [("abc", 0, "user", "a"), ("abc", 1, "assistant", "b"), ("7", 0, "user", None), (None, 0, "user", "x")]
    got = {r.conv_id: r.n_turns for r in chat.digest(chat.render(chat.canonical(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))).collect()}
    assert got == {"abc": 2, "7": 1, None: 1}
    pairs = spark.createDataFrame([("x-1", "q", "a"), ("x-1", "q", "a"), (None, "", None)], "id string, prompt string, response string")
    assert sorted(r.conv_id or "" for r in chat.render(chat.canonical(pairs)).collect()) == ["", "x-1", "x-1"]


def test_a_very_long_conversation(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<t "), F.col("id").cast("string")).alias("text"))
    (got,) = chat.digest(chat.render(chat.canonical(rows))).collect()
    loss = "".join(f"<t {i}" for i in range(1, 20_000, 2))
    assert got.n_turns == 20_000 and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "turns", "parts", "id")})
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.canonical(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1} and got[1].loss_chars == 1
    assert chat.digest(chat.render(chat.canonical(df.limit(0)))).count() == 0
    assert chat.mapping_for(spark.createDataFrame([], "a int").schema) is None


# 8. benchmark decontamination


def edits(a, b):
    """Words by which ``a`` is away from the nearest substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_are_found_at_any_allowed_distance(spark):
    r = random.Random(4)
    items = [(i, words(r.randint(8, 60), 100 + i)) for i in range(40)]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        k = decontam.allowed(len(w), 0.8)
        for e in range(k + 1):
            v = list(w)
            for _ in range(e):
                p, kind = r.randrange(len(v)), r.random()
                if kind < 0.5:
                    v[p] = "changed"
                elif kind < 0.75:
                    v.insert(p, "added")
                else:
                    v.pop(p)
            text = f"{words(30, 7 * e + i)} {' '.join(v).upper()}! {words(30, 11 * e + i)}"
            docs.append((len(docs), text, None))
            want.add((len(docs) - 1, i))
    docs += [(9_000 + i, words(200, 5_000 + i), None) for i in range(40)]
    found = decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x.distance for x in found}
    assert got.keys() >= want and {d for d, _ in got} == {d for d, _ in want}
    for x in r.sample(found, 30):
        item = [w.lower() for w in dict(items)[x.item_id].split()]
        text = [w.strip(decontam._OUTER).lower() for w in docs[x.doc_id][1].split()]
        assert x.distance == edits(item, text) and edits(item, text[x.start : x.end]) == x.distance


def test_leaks_are_found_at_both_ends_of_a_document(spark):
    """Items whose first or last words are missing, as first or last words of a document and as all of it."""
    items = [(i, words(n, 300 + n + i)) for n in (10, 30, 60) for i in range(100 * n, 100 * n + 10)]
    docs, want = [], {}
    for i, t in items:
        w = t.split()
        for e in range(1, decontam.allowed(len(w), 0.8) + 1):
            for text in (f"{' '.join(w[e:])} {words(30, e + i)}", " ".join(w[e:]), " ".join(w[:-e]), f"{words(30, e + i)} {' '.join(w[:-e])}"):
                want[len(docs), i] = e
                docs.append((len(docs), text, None))
    found = decontam.leaks(frame(spark, docs).coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.distance for x in found} == want
    assert all(0 <= x.start < x.end <= len(docs[x.doc_id][1].split()) for x in found)


@pytest.mark.parametrize("n", [100, 200, 300])
def test_long_leaks_are_found_at_the_largest_distance(spark, n):
    """Substitutions, insertions or deletions only, as many as are allowed."""
    r, items, docs, want = random.Random(n), [(i, words(n, 1_000 + n + i)) for i in range(10)], [], set()
    for i, t in items:
        for kind in range(3):
            v = t.split()
            for p in sorted(r.sample(range(n), decontam.allowed(n, 0.8)), reverse=True):
                v[p : p + 1] = (["changed"], [v[p], "added"], [])[kind]
            want.add((len(docs), i))
            docs.append((len(docs), f"{words(30, i)} {' '.join(v)} {words(30, 50 + i)}", None))
    found = decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and all(x.distance <= n // 5 for x in found)


def test_leak_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, words(120, 1)), (4, words(120, 1))], "item_id long, text string").withColumn("start", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(edge, items).collect()}
    assert {(4, 3), (5, 3), (6, 4), (7, 4), (None, 4)} <= got
    assert decontam.leaks(empty, items).count() == 0 and decontam.leaks(edge, items.limit(0)).count() == 0


# 9. near-duplicates


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def near_copies(n=150, seed=3):
    """A family of copies of one text whose distances lie about the threshold, chains, and others."""
    r, base, out = random.Random(seed), words(90, 40).split(), []
    chain = list(base)
    for i in range(n):
        w = list(base) if i % 3 else chain
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(10_000)}"
        out.append((1_000 + i, " ".join(w)))
    return out + [(i, words(r.randint(1, 60), 900 + i)) for i in range(60)] + [(70 + i, "a b c") for i in range(4)] + [(80, None), (81, ""), (82, "A B C")]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 40)
    rows = near_copies()
    want, sets = brute_components(rows, percent)
    got = neardup.near_duplicates(frame(spark, [(i, t, None) for i, t in rows]), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_components_of_the_corpus(spark, data):
    rows = [(i, t) for i, t, _ in documents(spark, data)]
    assert {r.doc_id: r.component_id for r in queries.op9_near_duplicates(spark, data).collect()} == brute_components(rows, 85)[0]


def test_sketch_estimates_and_fills():
    r = np.random.default_rng(1)
    for n, share in ((1, 1.0), (3, 0.4), (40, 0.5), (400, 0.85), (3_000, 0.8)):
        both = r.integers(1, 2**63, max(1, int(round(n * 2 * share / (1 + share)))), np.uint64)
        a, b = (np.unique(np.append(both, r.integers(1, 2**63, n - len(both), np.uint64))) if n > len(both) else np.unique(both) for _ in range(2))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = neardup.sketch(a), neardup.sketch(b)
        assert (x != neardup._EMPTY).all() and abs((x == y).mean() - real) < 0.2


def test_near_duplicate_edges(edge, empty):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 4, 5, 6, 7, None)} == {(1, 1), (4, 4), (5, 4), (6, 6), (7, 6), (None, None)}
    assert neardup.near_duplicates(empty).count() == 0


# 10. repeated substrings


def brute_cut(rows):
    n = substrings.LENGTH
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(hash(b[s : s + n]) for s in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone, last = bytearray(len(b)), 0
        for s in range(len(b) - n + 1):
            if count[hash(b[s : s + n])] > 1:
                gone[max(s, last) : s + n] = b"\1" * (s + n - max(s, last))
                last = s + n
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return collections.Counter(out)


def passages(seed=3):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "d" * 5000), (7, "ab" * 300), (8, "x" * 100 + "é" * 150), (9, "y" * 7 + "é" * 150)]
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    for i in range(10, 60):
        a, pre = r.randrange(2500), "".join(r.choice("ijklm") for _ in range(r.randrange(300)))
        v = list(base[a : a + r.randrange(150, 700)])
        if r.random() < 0.5:
            v[r.randrange(len(v))] = "Z"
        rows.append((i, pre + "".join(v) + pre[::-1]))
    return [*rows, (60, rows[20][1]), (61, rows[21][1]), (61, rows[21][1]), (None, rows[22][1])]


@pytest.mark.parametrize("most", [2_000, 1])
def test_cut_equals_brute_force(spark, most, monkeypatch):
    """Also with every group split until its members are alike."""
    monkeypatch.setattr(substrings, "GROUP", most)
    rows = passages()
    got = substrings.cut_repeats(frame(spark, [(i, t, None) for i, t in rows])).collect()
    assert collections.Counter(map(tuple, got)) == brute_cut(rows)


def test_cut_of_the_corpus(spark, data):
    rows = [(i, t) for i, t, _ in documents(spark, data)]
    assert collections.Counter(map(tuple, queries.op10_repeated_substrings(spark, data).collect())) == brute_cut(rows)


def test_group_halves_hold_every_window_once():
    r = random.Random(2)
    for _ in range(200):
        before, behind = r.randint(0, 136), r.randint(0, 136)
        text = bytes(r.randrange(256) for _ in range(max(200, before + 64 + behind)))
        todo, windows = [(5, 1, 1000, before, 64, True, text)], []
        while todo:
            g, k, base, off, core, need, t = todo.pop()
            parts = substrings.halves(g, k, base, off, core, need, t)
            assert all(p[4] > core and p[6][p[3] : p[3] + p[4]] == text[p[2] - 1000 + p[3] : p[2] - 1000 + p[3] + p[4]] for p in parts)
            todo += parts
            windows += [base - 1000] if core == 200 else []
        first, last = max(0, before + 64 - 200), min(before, len(text) - 200)
        assert set(range(first, last + 1)) <= set(windows) and len(windows) == len(set(windows))


def test_copies_of_a_row_are_told_of_once(spark):
    """What is gathered for rows alike in id and text doesn't grow with their number."""
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(5_000))
    told = [substrings.repeated_starts(frame(spark, [(1, text, None)] * n).select("doc_id", "text")).count() for n in (2, 400)]
    assert told[0] == told[1] > 0
    got = substrings.cut_repeats(frame(spark, [(1, text, None)] * 1_600)).collect()
    assert len(got) == 1_600 and {(x.n_removed, x.n_spans) for x in got} == {(5_000, 1)}


def test_cut_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert collections.Counter(map(tuple, substrings.cut_repeats(edge).collect())) == brute_cut(rows)
    assert substrings.cut_repeats(empty).count() == 0


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_order_and_common_prefixes(tmp_path):
    """Also with queues that hold three tuples and write all others to files."""
    r = random.Random(1)
    for trial in range(400):
        kinds = r.choice([1, 2, 3, 5, 256])
        b = bytes(r.randrange(kinds) for _ in range(r.randint(1, 60))) * r.choice([1, 1, 2, 6])
        out = list(suffix.suffixes(np.frombuffer(b, np.uint8), budget=3, folder=f"file://{tmp_path}/q" if trial % 3 == 0 else None))
        pos, common = (np.concatenate(x).tolist() for x in zip(*out, strict=True))
        assert pos[::-1] == sorted(range(len(b)), key=lambda i: b[i:])
        assert common == [0] + [min(suffix.LONGEST, shared(b[i:], b[j:])) for i, j in zip(pos[1:], pos, strict=False)]
    assert not list((tmp_path / "q").iterdir())


def test_a_shard_far_larger_than_the_budget(tmp_path, monkeypatch):
    """Half a million bytes with four thousand tuples in memory: the files come and go, and the result is that of the sort in memory."""
    r = np.random.default_rng(4)
    t = r.integers(97, 101, 500_000).astype(np.uint8)
    t[300_000:330_000] = t[:30_000]
    written = []
    push = suffix.Queues.push
    monkeypatch.setattr(suffix.Queues, "push", lambda q, *a: (push(q, *a), written.append(q.written)))
    small = [np.concatenate(x) for x in zip(*suffix.suffixes(t, 200, budget=4_000, folder=f"file://{tmp_path}/q"), strict=True)]
    assert max(written) > 200_000 and not list((tmp_path / "q").iterdir())
    large = [np.concatenate(x) for x in zip(*suffix.suffixes(t, 200), strict=True)]
    assert all((x == y).all() for x, y in zip(small, large, strict=True))


# the pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("row", F.lit(1))
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = cp.quality_classifier(spark, docs, data)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in ids for i in clean) >= 0.95 * len(clean)
    one = {r.doc_id for r in cp.near_duplicates(spark, docs, data).collect()}
    assert one == set(brute_components(list(rows.items()), 80)[0].values())
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = {r.doc_id for r in cp.decontamination(spark, docs, data).collect()}
    assert all(not any(x in rows[i] for x in items) for i in left) and len(left) > 0.8 * len(rows)
    red = cp.personal_data(spark, docs, data)
    assert red.columns == docs.columns and red.where(F.col("text").rlike(BASE["email"])).count() == 0
    assert red.where("n_chars <> char_length(text)").count() == 0
    assert cp.mixture(spark, docs, data).agg(F.sum("words")).first()[0] > 0
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]


def test_pipeline_stages_decide_for_each_row(spark, edge, data, tmp_path):
    """Null ids, repeated rows, and one id for texts of which only some go."""
    import corpus_pipeline as cp

    bulk = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    base, copy = words(120, 1), words(120, 1) + " tail"
    df = edge.unionByName(frame(spark, [(None, base, "a"), (None, copy, "a"), (11, words(80, 5), "a"), (11, copy, "b"), (None, words(90, 6), "a"), (None, None, "a")]))
    one = cp.near_duplicates(spark, df.repartition(3), data)
    got = bulk(one)
    assert one.columns == df.columns and one.where("doc_id is not null").agg(F.min("shard")).first()[0] == "x"
    want = collections.Counter({(i, t): 1 for i, t in [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (6, base), (11, words(80, 5)), (None, words(90, 6)), (None, None)]})
    assert {k: n for k, n in got.items() if k[0] not in (8, 9, 10)} == want and sum(got.values()) == len(want) + 3

    spark.createDataFrame([(1, base), (2, words(90, 6))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = cp.decontamination(spark, df, str(tmp_path))
    assert left.columns == df.columns
    assert bulk(left) == collections.Counter({k: n for k, n in bulk(df).items() if k[1] not in (base, copy, words(90, 6))})

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    toxic = [r.text for r in docs.collect() if r.doc_id in labels and labels[r.doc_id].toxic == 1]
    clean = [r.text for r in docs.collect() if r.doc_id in labels and labels[r.doc_id].toxic == 0 and labels[r.doc_id].quality == 1]
    kept, n = bulk(cp.quality_classifier(spark, docs, data)), collections.Counter(bulk(docs))
    gone = {t for _, t in n - kept}
    bad, good = [t for t in toxic if t in gone], [t for t in clean if t not in gone]
    assert bad and good
    more = spark.createDataFrame([(None, t) for t in bad] + [(-1, bad[0]), (-1, good[0]), (None, good[0]), (None, good[0])], "doc_id long, text string")
    assert bulk(cp.quality_classifier(spark, docs.unionByName(more), data)) - kept == collections.Counter({(-1, good[0]): 1, (None, good[0]): 2})


def test_every_stage_on_edge_rows_and_on_none(spark, edge, empty, data):
    """Columns with clashing names pass through; nothing is made up; blanks stay in all stages but the last; very long texts are whole."""
    import corpus_pipeline as cp

    before = collections.Counter(r.doc_id for r in edge.collect())
    for name, stage in cp.STAGES:
        none = stage(spark, empty, data)
        assert set(empty.columns) <= set(none.columns) and none.count() == 0, name
        out = stage(spark, edge, data)
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in CLASH), name
        if name == "mixture":
            assert not {r.doc_id for r in rows} & {1, 2, 3} and {r.doc_id for r in rows} <= set(before)
            continue
        assert out.columns == edge.columns and not collections.Counter(r.doc_id for r in rows) - before, name
        assert {1, 2, 3} <= {r.doc_id for r in rows}, name
        if name != "near_duplicates":
            assert all(sum(r.doc_id == i for r in rows) in (0, before[i]) for i in (6, 7, None)), name
        long = [r.text for r in rows if r.doc_id == 8]
        assert not long or len(long[0].split()) == 30_000, name


def test_release_deletes_what_the_pipeline_wrote(spark, data, tmp_path):
    import corpus_pipeline as cp

    spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}/shared")
    try:
        assert cp.run(spark, data).count() > 0 and list((tmp_path / "shared").rglob("*.parquet"))
        scratch.release(spark)
        assert not list((tmp_path / "shared").rglob("*.parquet"))
    finally:
        spark.conf.unset("spark.checkpoint.dir")


def test_memo_is_bounded(monkeypatch):
    from threadloom.llm import words as w

    monkeypatch.setattr(w, "MEMO_CAP", 3)
    m = Memo(len)
    assert [m["a" * k] for k in range(9)] == list(range(9)) and len(m) <= 3


def test_the_judge_gets_a_batch_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from threadloom.llm import quality, words

    class Recorder:
        value = (np.zeros(quality.DIM, np.float32), 0.0, quality.ToxicScorer([]))

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = []
    monkeypatch.setattr(quality, "_fit", lambda docs, labels: Recorder())
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: got.append(f) or self)
    quality.kept(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["some words here"] * 5000})
    out = list(got[0](iter([batch])))
    assert max(len(b) for b in out) <= words.PIECE and [x for b in out for x in b.column(0).to_pylist()] == list(range(5000))


def test_the_model_keeps_no_shuffle_of_an_earlier_sweep(spark, data, monkeypatch):
    """A sweep's shuffles go with the collection behind it, and not with the one behind the next sweep."""
    import time

    def held(most=-1):
        """Shuffles that Spark holds, once they are ``most`` or three seconds have passed."""
        until = time.monotonic() + 3
        while (n := spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()) > most and time.monotonic() < until:
            time.sleep(0.1)
        return n

    let_go = scratch.let_go
    for _ in range(2):  # what earlier tests have left
        let_go(spark)
        before = held()
    after = []
    monkeypatch.setattr(scratch, "let_go", lambda s: (let_go(s), after.append(held(before))))
    hpylm.score_documents(spark.read.parquet(f"{data}/documents.parquet"))
    assert len(after) == hpylm.SWEEPS + 2 and max(after) <= before, (before, after)


def test_scores_read_the_seatings_that_the_sweeps_made(monkeypatch):
    """No pair is seated again for the scores."""

    class S:
        count = None

    monkeypatch.setattr(hpylm, "_seating", lambda *_: pytest.fail("seated again"))
    monkeypatch.setattr(hpylm, "predictive", lambda chunk, count, seen, t, s, m: t)
    sweeps = range(hpylm.SWEEPS - hpylm.SAMPLES + 1, hpylm.SWEEPS + 1)
    assert hpylm.sampled(None, None, [(S(), None)] * (hpylm.SAMPLES + 1), {k: f"tables {k}" for k in sweeps}) == [f"tables {k}" for k in sweeps]
