"""Quality classification from weak labels.

Overlapping heuristics vote good, bad or nothing on each document.  The votes
of *all* documents are counted by pattern (3 to the number of heuristics at
most), and expectation-maximisation on these counts estimates how each
heuristic votes on good and on bad documents, hence a posterior for every
pattern.  A hashed linear scorer is then trained on posteriors of a bounded
sample and scores every whole document by its words and their shapes.

Toxic documents have a second hashed linear scorer.  No heuristic about form
can see them, so its labellers are words and word beginnings, and their
accuracies are counted on a bounded sample of a table of known documents.  Those
that tell the classes apart by more than the luck of so many candidates are the
scorer's features, by how often they occur, beside the length of the document.

Defined results: a null or blank text gets no vote against it, scores the
prior and is kept; very long texts are scored whole; repeated rows get equal
results; without a label table, or with an empty one, nothing is toxic; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .words import Memo, pieces

#: Dimensions of the hashed scorers.
DIM = 1 << 16
#: The dimension of a token that repeats the one before; such a token counts once for itself and once here.
REPEAT = DIM - 1
#: Documents on which the quality scorer, and labelled documents on which the toxicity scorer are fitted at most, and bytes of text of either sample.
QUALITY_SAMPLE, TOXIC_SAMPLE, SAMPLE_BYTES = 6_000, 20_000, 256_000_000
#: Chance that any feature of the toxicity scorer is there by luck.
LUCK = 0.01
GOOD, BAD, NONE = 2, 1, 0
_OUTER = ".,;:!?\"'()[]{}<>…«»„“”‘’`*#%$&|-–—_/\\=+~^@"


#: Bits of a token's code: letters, capitals, then one flag each.
_SYMBOL, _RUN, _PLAIN, _SMALL, _LONG = (1 << k for k in (24, 25, 26, 27, 28))
_PROSE = re.compile(r"[^\W\d_]?[^\W\d_A-Z]*(?:['’-][^\W\d_]+)?[.,;:!?]?")


def token_code(w: str) -> int:
    """What the heuristics need to know of a token, computed once for each distinct one."""
    letters, upper = sum(c.isalpha() for c in w), sum(c.isupper() for c in w)
    core = w.rstrip(_OUTER)
    code = min(letters, 4095) | min(upper, 4095) << 12
    if not letters and not any(c.isdigit() for c in w):
        code |= _SYMBOL
    if len(w) - len(core) >= 2 and w[-1] == w[-2]:
        code |= _RUN
    if upper <= 1 and _PROSE.fullmatch(w):
        code |= _PLAIN | (_SMALL if letters <= 3 else 0)
    if len(w) > 40:
        code |= _LONG
    return code


HEURISTICS = ("prose", "small_words", "capitals", "symbol_runs", "bare_symbols", "repeated_lines", "repeated_words", "few_words", "long_words")
#: Belief about each heuristic before any vote is seen, as (good | good, bad | good, good | bad, bad | bad): the first two
#: say good or bad, the others only bad.
_BELIEF = [(0.85, 0.02, 0.05, 0.80), (0.80, 0.03, 0.20, 0.40)] + [(0.0, 0.01, 0.0, 0.35)] * 7
#: Weight of that belief against the votes counted.
_TRUST = 0.2


def repeats(words: list[str]) -> int:
    """Tokens that equal the one before."""
    return sum(map(eq, words, words[1:]))


def votes(text: str | None, memo: Memo) -> tuple[int, ...]:
    """One vote of each heuristic; all of them abstain on a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (NONE,) * len(HEURISTICS)
    c = np.fromiter(map(memo.__getitem__, words), np.int64, n)
    letters, upper = int((c & 4095).sum()), int((c >> 12 & 4095).sum())

    def share(flag: int) -> float:
        return np.count_nonzero(c & flag) / n

    twice = repeats(words)
    # a word said again is no more prose
    prose, small = share(_PLAIN) - twice / n, share(_SMALL) - twice / n
    lines = [s for s in text.split("\n") if s.strip()]
    bad = (
        upper > 0.5 * max(1, letters) and letters > 8, share(_RUN) > 0.10, share(_SYMBOL) > 0.12,
        len(lines) > 3 and len(set(lines)) < 0.5 * len(lines), twice > 0.2 * n, n >= 50 and len(set(words)) < 0.2 * n, share(_LONG) > 0.05,
    )
    return (GOOD if prose > 0.8 else BAD if prose < 0.6 else NONE, GOOD if small > 0.12 else BAD if small < 0.01 and n >= 20 else NONE, *(BAD if x else NONE for x in bad))


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id, votes (one digit a heuristic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(token_code)
        for b in pieces(batches):
            v = ["".join(map(str, votes(t, memo))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.string())], names=["doc_id", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string")


class LabelModel:
    """Class prior and, for each heuristic, the chance of each vote given the class.

    Most heuristics only ever speak against a document.  What the votes alone
    leave open, which of two kinds of documents is the bad one, a weak belief
    about each heuristic settles; the votes outweigh it.
    """

    def __init__(self, patterns: list[str], counts: list[int], rounds: int = 60):
        v = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), len(HEURISTICS))
        n = np.array(counts, np.float64)
        belief = np.array([[[1 - gb - bb, 1 - gg - bg], [bb, bg], [gb, gg]] for gg, bg, gb, bb in _BELIEF])
        self.prior, self.chance = 0.85, belief.copy()
        for _ in range(rounds if len(patterns) else 0):
            q = self.posterior(v)
            w = np.stack([n * (1 - q), n * q], axis=1)
            self.prior = float((w[:, 1].sum() + 8.5) / (w.sum() + 10))
            for h in range(len(HEURISTICS)):
                seen = np.stack([w[v[:, h] == vote].sum(0) for vote in range(3)])
                self.chance[h] = np.maximum(seen + _TRUST * w.sum(0) * belief[h] + 1e-3, 1e-9)
                self.chance[h] /= self.chance[h].sum(0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes are good."""
        log = np.log([1 - self.prior, self.prior]) + sum(np.log(self.chance[h, v[:, h]]) for h in range(len(HEURISTICS)))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """For each heuristic the chance that a vote it casts is right."""
        p = np.array([1 - self.prior, self.prior])
        cast = self.chance[:, 1:, :] * p
        return {h: float((cast[i, 0, 0] + cast[i, 1, 1]) / cast[i].sum()) for i, h in enumerate(HEURISTICS)}


def _shape(w: str) -> str:
    """Kinds of characters in order, runs drawn together to two at most."""
    out = []
    for c in w:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c if c in _OUTER else "?"
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)[:12]


def features(w: str) -> tuple[int, int]:
    """The dimensions of a token: its word, and its shape."""
    word = w.lower().strip(_OUTER) or w
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % DIM, xxhash.xxh3_64_intdigest(b"shape:" + _shape(w).encode("utf-8", "surrogatepass")) % DIM


def _counts(docs: DataFrame) -> DataFrame:
    """y with the dimensions of a document and how often each occurs, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features)
        for b in pieces(batches):
            ds, cs = [], []
            for t in b.column(1).to_pylist():
                words = (t or "").split()
                d = np.array([memo[w] for w in words] + [(REPEAT, REPEAT)] * repeats(words), np.int32).ravel()
                u, c = np.unique(d, return_counts=True)
                ds.append(u.astype(np.int32).tobytes())
                cs.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ds, pa.binary()), pa.array(cs, pa.binary())], names=["y", "dims", "counts"])

    return docs.select("y", "text").mapInArrow(run, "y double, dims binary, counts binary")


class LinearScorer:
    """Logistic regression on the shares of a document's hashed tokens."""

    def __init__(self, rows: list, passes: int = 12, rate: float = 40.0):
        self.w, self.b = np.zeros(DIM), 0.0
        data = []
        for r in rows:
            d, c = np.frombuffer(r.dims, np.int32), np.frombuffer(r.counts, np.int32)
            if len(d):
                data.append((d, c / c.sum(), r.y))
        rng = np.random.default_rng(3)
        for k in range(passes):
            step = rate / (1 + k)
            for i in rng.permutation(len(data)):
                d, x, y = data[i]
                g = y - 1 / (1 + np.exp(-np.clip(self.w[d] @ x + self.b, -30, 30)))
                self.w[d] += step * g * x
                self.b += 0.02 * step / rate * g
        self.w = self.w.astype(np.float32)


def _sample(df: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """y and text of a reproducible sample of the documents in ``df`` (doc_id, y): ``most`` rows and SAMPLE_BYTES at most."""
    picked = df.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # a sum over at most so many rows
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", F.xxhash64("text")))
    sizes = scratch.table(rows.select("doc_id", "y", "text"), "sample")
    last = sizes.select("doc_id", F.coalesce(size, F.lit(0)).alias("upto")).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id").distinct()
    return sizes.join(F.broadcast(last), "doc_id").select("y", "text")


def fit_quality(docs: DataFrame, table: DataFrame) -> tuple[LabelModel, LinearScorer]:
    by = sorted(table.groupBy("votes").count().collect())
    model = LabelModel([r.votes for r in by], [r["count"] for r in by])
    if not by:
        return model, LinearScorer([])
    post = model.posterior(np.array([[int(c) for c in r.votes] for r in by]))
    known = table.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(by, post, strict=True)], "votes string, y double")
    rows = _sample(table.join(F.broadcast(known), "votes").select("doc_id", "y"), docs, QUALITY_SAMPLE)
    return model, LinearScorer(sorted(_counts(rows).collect()))


def telling(w: str) -> list[int]:
    """Hashes of a token's word and of its first letters, four to six."""
    word = w.lower().strip(_OUTER)
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in {word, *(f"{word[:k]}+" for k in (4, 5, 6) if len(word) >= k)} if len(x) >= 3]


class ToxicScorer:
    """Logistic regression on the logarithms of how often telling features occur and of the number of tokens.

    ``rows`` have y, the number of tokens, the features and their counts.
    """

    def __init__(self, rows: list, rounds: int = 400):
        names = sorted({f for r in rows for f in r.f})
        place = {f: i for i, f in enumerate(names)}
        m, length = len(names), len(names)
        at = np.concatenate([np.array([place[f] for f in r.f] + [length], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r.f) + 1 for r in rows])
        x = np.concatenate([np.log1p(np.array([*r.c, r.n], np.float64)) for r in rows]) if rows else np.zeros(0)
        y = np.array([r.y for r in rows])
        n = max(1, len(rows))
        # features on one scale; only the length is centred, so that absent ones stay zero
        mean = np.bincount(at, x, m + 1) / n
        scale = np.sqrt(np.maximum(np.bincount(at, x * x, m + 1) / n - mean**2, 1e-12)) + 1e-9
        middle = mean[length]
        x = (x - np.where(at == length, middle, 0.0)) / scale[at]
        w, b = np.zeros(m + 1), 0.0
        for _ in range(rounds if m else 0):
            z = np.bincount(row, w[at] * x, len(rows)) + b
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            w -= np.bincount(at, g[row] * x, m + 1) / n + 1e-4 * w
            b -= g.mean()
        w /= scale
        self.weights = {f: float(w[i]) for f, i in place.items()}
        self.length = float(w[length]) if m else 0.0
        self.bias = b - self.length * middle if m else -30.0

    def __call__(self, counts: Counter[int], n: int) -> float:
        return self.bias + self.length * log1p(n) + sum(self.weights[f] * log1p(c) for f, c in counts.items())


def _likelier(n: Column, toxic: Column, prior: float) -> Column:
    """How far the share of toxic documents among n is above the prior, as the logarithm of how unlikely that is by luck."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), toxic / n))
    return F.when(p > prior, n * (p * F.log(p / prior) + (1 - p) * F.log((1 - p) / (1 - prior)))).otherwise(0.0)


def fit_toxic(docs: DataFrame, labels: DataFrame) -> ToxicScorer:
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(telling)
        for b in pieces(batches):
            n, fs, cs = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").split()
                seen = Counter(f for w in words for f in memo[w])
                n.append(len(words))
                fs.append(sorted(seen))
                cs.append([seen[f] for f in fs[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fs, pa.list_(pa.int64())), pa.array(cs, pa.list_(pa.int64()))], names=["y", "n", "f", "c"])

    rows = _sample(known, docs, TOXIC_SAMPLE).groupBy("text").agg(F.max("y").alias("y")).select("y", "text")
    rows = scratch.table(rows.mapInArrow(run, "y double, n long, f array<long>, c array<long>"), "toxic-features")
    size, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not size or not 0 < toxic < size:
        return ToxicScorer([])
    by = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).where("n > 1")
    by = scratch.table(by, "toxic-labellers")
    least = float(np.log(max(1, by.count()) / LUCK))
    good = by.where((_likelier(F.col("n"), F.col("toxic"), toxic / size) > least) & (F.col("toxic") >= 0.5 * F.col("n"))).select("f")
    pairs = rows.select("y", "n", F.monotonically_increasing_id().alias("d"), F.arrays_zip("f", "c").alias("fc"))
    hits = pairs.select("d", F.explode("fc").alias("x")).select("d", "x.f", "x.c").join(good, "f")
    hits = hits.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("x"))
    found = pairs.drop("fc").join(hits, "d", "left").select("y", "n", F.coalesce(F.transform("x", lambda x: x["f"]), F.array().cast("array<long>")).alias("f"), F.coalesce(F.transform("x", lambda x: x["c"]), F.array().cast("array<long>")).alias("c"))
    return ToxicScorer(sorted(found.collect()))


#: Added to a token's weight where it has a telling feature; far above any sum of weights.
_MARK = 1e9


class _Judge:
    """Both scorers, for the texts of one task."""

    def __init__(self, w: np.ndarray, bias: float, toxic: ToxicScorer):
        tells = toxic.weights

        def weigh(token: str) -> float:
            a, s = features(token)
            return float(w[a] + w[s]) / 2 + (_MARK if tells and any(f in tells for f in telling(token)) else 0.0)

        self.memo, self.bias, self.again, self.toxic = Memo(weigh), bias, float(w[REPEAT]), toxic
        self.tells = Memo(lambda token: [f for f in telling(token) if f in tells])

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[bool]]:
        """For each text the chance that it is good, and whether it is toxic."""
        q, x = [], []
        for t in texts:
            words = (t or "").split()
            got = np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))
            marked, twice = np.flatnonzero(got > _MARK / 2), repeats(words)
            z = (float(got.sum()) - len(marked) * _MARK + twice * self.again) / (len(got) + twice) + self.bias if len(got) else 30.0
            q.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            x.append(len(marked) > 0 and self.toxic(Counter(f for i in marked.tolist() for f in self.tells[words[i]]), len(words)) > 0)
        return q, x


def _fit(docs: DataFrame, labels: DataFrame | None) -> Broadcast:
    """What a judge is made of, on all executors."""
    table = scratch.table(vote_table(docs), "votes")
    _, scorer = fit_quality(docs, table)
    toxic = fit_toxic(docs, labels) if labels is not None else ToxicScorer([])
    return docs.sparkSession.sparkContext.broadcast((scorer.w, scorer.b, toxic))


def classify(docs: DataFrame, labels: DataFrame | None = None, keep_at: float = 0.5) -> DataFrame:
    """doc_id, quality (the scorer's chance that it is good), toxic, kept."""
    shared = _fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(*shared.value)
        for b in pieces(batches):
            q, x = judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.float64()), pa.array(x, pa.bool_())], names=["doc_id", "quality", "toxic"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double, toxic boolean")
    return out.withColumn("kept", (F.col("quality") >= keep_at) & ~F.col("toxic"))


def kept(docs: DataFrame, labels: DataFrame | None = None, keep_at: float = 0.5) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns; every row is judged by itself, whatever its id."""
    shared, at = _fit(docs.select("doc_id", "text"), labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(*shared.value)
        for b in pieces(batches):
            q, x = judge(b.column(at).to_pylist())
            yield b.filter(pa.array((np.array(q) >= keep_at) & ~np.array(x, np.bool_)))

    return docs.mapInArrow(run, docs.schema)
