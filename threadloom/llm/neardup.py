"""Near-duplicates: fast similarity sketching, banding, exact verification, components.

The sketch of a set has T coordinates.  In round i every element is hashed to
one of the T bins with a value; a coordinate keeps the least value of the first
round in which its bin got anything.  T further rounds that serve one bin each
fill whatever is left, so every coordinate is filled, and the share of equal
coordinates of two sets concentrates about their similarity as with
independent permutations, for about |A| + T log T hashes.

Documents with equal sets are one vertex.  Vertices that share a band of
coordinates are candidates; links are confirmed on full sets.  First each
vertex is held against one centre, that of its largest bucket, which joins the
large groups of copies without listing their pairs; a second round does so
again in the buckets that still hold several components.  Whoever is then
outside the largest component of its family (what such buckets connect) is
compared with all of the family, so no link between components is lost.

Defined results: a null or blank text has an empty set, is linked with nothing
and is its own component; a text with fewer words than a shingle is one
shingle; a row without an id is linked with nothing; repeated rows get equal
results; rows that share an id but not a text are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .words import hash_memo, mix, shingle_set, split_words

#: 32 bands of 4: a pair of similarity 0.8 is missed with a chance of 5e-8, one of 0.85 with 1e-10.
T, BANDS = 128, 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EDGES = np.arange(T, dtype=np.uint64) << np.uint64(57)
_BIN = np.uint64(127 << 57)
#: Members of a family that a task compares with its leftovers.
TILE = 1024


def sketch(a: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set of hashes.  A coordinate holds bin, round and value, in this order of bits."""
    out = np.full(T, _EMPTY)
    step, i = max(1, -(-9 * T // len(a))), 0
    while i < T and (out == _EMPTY).any():
        rounds = np.arange(i, min(T, i + step), dtype=np.uint64)
        m = mix(a[None, :] ^ _SEEDS[rounds.astype(np.int64)][:, None])
        keys = np.sort(((m & _BIN) | (rounds << np.uint64(48))[:, None] | ((m << np.uint64(7)) >> np.uint64(16))).ravel())
        at = np.minimum(np.searchsorted(keys, _EDGES), len(keys) - 1)
        got = keys[at]
        fill = ((got & _BIN) == _EDGES) & (got >= _EDGES) & (out == _EMPTY)
        out[fill] = got[fill]
        i += step
    for b in np.flatnonzero(out == _EMPTY):
        value = (mix(a ^ _SEEDS[T + b]) >> np.uint64(16)).min()
        out[b] = _EDGES[b] | np.uint64((T + b) << 48) | value
    return out


_BAND_SEED = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def bands(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _BAND_SEED.copy()
        for col in s.reshape(BANDS, T // BANDS).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + col)
    return h.view(np.int64)


def set_name(a: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order of its hashes."""
    with np.errstate(over="ignore"):
        return tuple(x.sum(dtype=np.uint64).view(np.int64).item() for x in (mix(a), mix(a ^ _SEEDS[0])))


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (which name the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            sizes, k1, k2, out = [], [], [], []
            for text in b.column(1).to_pylist():
                a = shingle_set(split_words(text), memo, n)
                sizes.append(len(a))
                x, y = set_name(a)
                k1.append(x)
                k2.append(y)
                out.append(bands(sketch(a)) if len(a) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """v, hashes: the full shingle set, as bytes, of each vertex in ``reps``, from a document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            sets = [shingle_set(split_words(t), memo, n) for t in b.column(1).to_pylist()]
            names = [set_name(a) for a in sets]
            cols = [pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(a) for a in sets], pa.int64()), pa.array([a.tobytes() for a in sets], pa.binary())], names=["k1", "k2", "n_shingles", "hashes"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps.select("rep").distinct(), "rep", "left_semi")
    found = wanted.mapInArrow(run, "k1 long, k2 long, n_shingles long, hashes binary")
    # rows of one id may hold other texts, so a vertex finds its set by name
    return found.join(reps.select("v", "k1", "k2", "n_shingles"), ["k1", "k2", "n_shingles"]).select("v", "hashes").dropDuplicates(["v"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    with_a = pairs.join(sets.select(F.col("v").alias("a"), F.col("hashes").alias("ha")), "a")
    both = with_a.join(sets.select(F.col("v").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v, c: the least vertex that each vertex of the links (a, b) can reach.

    Labels spread to neighbours and then jump to the label of their label, so a
    path is halved in each round.
    """
    links = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    first = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))
    labels = scratch.table(first, "labels")
    while True:
        seen = links.join(labels.select(F.col("v").alias("b"), F.col("c")), "b").groupBy("a").agg(F.min("c").alias("m"))
        spread = labels.join(seen.withColumnRenamed("a", "v"), "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = spread.join(labels.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select("v", "old", F.least("c", "cc").alias("c"))
        new = scratch.table(jump, "labels")
        scratch.drop(labels)
        labels = new.select("v", "c")
        if new.where("c <> old").limit(1).count() == 0:
            scratch.drop(links)
            return labels


#: Rounds in which each member is held against one centre, before what is left is compared in whole.
ROUNDS = 2


def _members(reps: DataFrame) -> DataFrame:
    """v, key, n, degree: the buckets with n > 1 members; the degree of a member is the size of its buckets in sum."""
    spread = reps.select("v", F.explode("bands").alias("key"))
    by = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return spread.join(by, "key").select("v", "key", "n", F.sum("n").over(Window.partitionBy("v")).alias("degree"))


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets that hold several components, with their own one, the bucket's least one and its centre.

    The centre is the member of the largest degree: in a group of copies the
    one that most others are near to.
    """
    c = F.col("v") if labels is None else F.coalesce("c", "v")
    rows = (members if labels is None else members.join(labels, "v", "left")).select("v", "key", "n", "degree", c.alias("c"))
    top = F.max(F.struct("degree", (-F.col("v")).alias("minus"), F.col("c").alias("of")))
    by = rows.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), top.alias("top")).where("least <> most")
    return rows.drop("degree").join(by.select("key", "least", "top"), "key")


def _stars(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """a, b: one pair for each member of an open bucket, with the centre of the largest whose centre is of another component."""
    rows = _open(members, labels).where("c <> top.of")
    best = F.max(F.struct("n", "top"))
    return rows.groupBy("v").agg(best.alias("best")).select(F.col("v").alias("a"), (-F.col("best.top.minus")).alias("b"))


def common_bands(percent: int, chance: float = 1e-7) -> int:
    """Bands that two sets at the threshold share but for the given chance."""
    p, total, m = (percent / 100) ** (T // BANDS), 0.0, 0
    while True:
        total += comb(BANDS, m) * p**m * (1 - p) ** (BANDS - m)
        if total > chance:
            return max(1, m)
        m += 1


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def _join_rest(table: pa.Table, percent: int, least: int) -> pa.Table:
    """Links between leftover members and the others of one tile, none inside a component that is known."""
    comp = table["c"].to_pylist()
    ids = table["v"].to_pylist()
    left = np.flatnonzero(np.asarray(table["is_left"]))
    other = np.flatnonzero(~np.asarray(table["is_left"]))
    sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    b = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(ids), BANDS)
    sizes = np.array([len(x) for x in sets], np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out: list[tuple[int, int]] = []
    b_other, s_other = b[other], sizes[other]
    for x in left.tolist():
        share = (b_other == b[x]).sum(1)
        fits = (share >= least) & (100 * np.minimum(s_other, sizes[x]) >= percent * np.maximum(s_other, sizes[x]))
        at = np.flatnonzero(fits)
        for k in at[np.argsort(-share[at], kind="stable")].tolist():
            y = int(other[k])
            if ids[x] == ids[y] or find(comp[x]) == find(comp[y]):
                continue
            n = _overlap(sets[x], sets[y])
            if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                out.append((ids[x], ids[y]))
                root[find(comp[x])] = find(comp[y])
    cols = list(zip(*out, strict=True)) or [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _rest(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that stars have not found.

    Only members that share enough buckets with other components can have one.
    They form families, whatever open buckets connect.  Inside a family
    everybody outside its largest component is compared with all others, tile
    by tile: members are dealt to tiles of about TILE and the leftovers are
    sent to each.
    """
    rows = scratch.table(_open(members, labels).select("v", "c", "least"), "open-buckets")
    least = common_bands(percent)
    families = components(rows.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")))
    fam = rows.groupBy("v", "c").agg(F.count("*").alias("open")).where(F.col("open") >= least).select("v", "c")
    fam = scratch.table(fam.join(families.select(F.col("v").alias("c"), F.col("c").alias("family")), "c").select("v", "c", "family"), "families")
    per = fam.groupBy("family", "c").agg(F.count("*").alias("m"))
    per = per.groupBy("family").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.sum("m").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    live = fam.join(per.drop("parts"), "family")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    full = live.join(reps.select("v", "bands"), "v").join(sets, "v")
    full = full.select("family", "v", "c", "main", tiles.alias("tiles"), "bands", "hashes")
    full = scratch.table(full, "family-sets")
    own = full.select("family", F.pmod(F.xxhash64("v"), F.col("tiles").cast("long")).cast("int").alias("tile"), F.lit(False).alias("is_left"), "v", "c", "bands", "hashes")
    sent = full.where("c <> main").select("family", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("is_left"), "v", "c", "bands", "hashes")
    return own.unionByName(sent).groupBy("family", "tile").applyInArrow(lambda t: _join_rest(t, percent, least), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the one document of each component that stays)."""
    sk = scratch.table(sketches(docs, n), "sketches")
    named = sk.where("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = scratch.table(reps.withColumn("v", F.monotonically_increasing_id()), "sets")
    members = scratch.table(_members(reps), "buckets")
    sets = scratch.table(full_sets(docs, reps.join(members.select("v").distinct(), "v", "left_semi"), n), "full-sets")
    labels, links = None, None
    for _ in range(ROUNDS):
        new = scratch.table(confirm(_stars(members, labels), sets, percent), "confirmed")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    links = links.unionByName(scratch.table(_rest(members, labels, reps, sets, percent), "confirmed"))
    named_by = reps.join(components(links), "v", "left").select("k1", "k2", "n_shingles", "rep", F.coalesce("c", "v").alias("c"))
    least = named_by.groupBy("c").agg(F.min("rep").alias("component_id"))
    names = named_by.join(least, "c").select("k1", "k2", "n_shingles", "component_id")
    out = sk.drop("bands").join(names, ["k1", "k2", "n_shingles"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce(linked, F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
