"""Removal of repeated byte strings, by sampled anchors and induced suffix sorting.

A string of LENGTH bytes that occurs twice holds, at the same place in both,
the least of its ANCHOR-byte pieces by hash.  So every document marks the
pieces that are least in some window, and only around marks whose hash occurs
again is there anything to look for.  The surroundings of a mark are
what the windows cover in which it is the least.

Marks with equal surroundings settle each other: all their windows are
repeated, and one of them stands for all.  Where a mark has several different
surroundings, these are a group.  Groups are put into shards, in which the
suffixes are sorted by induction; neighbours with a common prefix of LENGTH
bytes are repeated.  A group that is too large for a shard is split by what
stands beside the piece: every window holds half of its other bytes on the
right or on the left of the piece, so windows that are alike go to the same
part by the longer piece that they share, and so on until parts are small or
the piece is a whole window.

All counts are over all documents.  Matches never cross documents.

Defined results: a null text counts as empty; texts under LENGTH bytes lose
nothing; repeated rows repeat each other, so they lose everything from LENGTH
bytes on; runs of one character are repeated from one byte beyond LENGTH on;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .suffix import suffixes
from .words import mix

LENGTH, ANCHOR = 200, 64
#: Pieces in a window, which is also the reach of a mark's surroundings to the left.
SPAN = LENGTH - ANCHOR + 1
#: Bytes hashed at once, bytes of surroundings of one shard, surroundings of a group that goes to a shard in whole.
SLAB, SHARD, GROUP = 2_000_000, 1_000_000, 2_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept for the process."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLAB + SLAB // 4)
        _powers[:] = [np.cumprod(np.full(m, _BASE)), np.cumprod(np.full(m, _INV))]
    return _powers[0], _powers[1]


def piece_hashes(t: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    up, down = _power(len(t))
    total = np.append(np.uint64(0), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)]))
    return mix((total[size:] - total[:-size]) * down[: len(t) - size + 1])


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad: np.uint64) -> np.ndarray:
    """f over each window of w, by prefixes and suffixes of blocks of w."""
    n = len(x)
    m = -(-n // w) * w
    b = np.full(m, pad)
    b[:n] = x
    b = b.reshape(-1, w)
    fore = f.accumulate(b, axis=1).ravel()
    back = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], fore[w - 1 : n])


def marks(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each mark, and its first and last window.

    Every window inside a document, whose ends ``ends`` are, belongs to its
    least piece, the leftmost one on a tie.  A mark's windows lie side by side.
    """
    nothing = np.zeros(0, np.int64)
    if len(t) < LENGTH:
        return nothing, nothing.astype(np.uint64), nothing, nothing
    h = piece_hashes(t, ANCHOR)
    least = _sliding(h, SPAN, np.minimum, _TOP)
    begins = np.append(0, ends[:-1])
    # no window may cross the end of a document
    for a, e in zip(begins.tolist(), ends.tolist(), strict=True):
        least[max(a, e - LENGTH + 1) : e] = 0
    padded = np.zeros(len(h) + SPAN - 1, np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, SPAN, np.maximum, np.uint64(0)) == h)
    mark = h[at]
    # runs of windows with one least hash; a mark's windows lie in the last such run before it that has its hash
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    stop = np.append(start[1:], len(least)) - 1
    run = np.searchsorted(start, at, "right") - 1
    off = np.flatnonzero(least[start[run]] != mark)
    while len(off):
        run[off] -= 1
        off = off[least[start[run[off]]] != mark[off]]
    first, last = start[run].copy(), np.minimum(stop[run], at)
    # of marks in one run each has the windows behind the one before it
    same = np.flatnonzero(run[1:] == run[:-1]) + 1
    first[same] = np.maximum(first[same], at[same - 1] + 1)
    own = first <= last
    return at[own], mark[own], first[own], last[own]


def _key() -> Column:
    """A row's key; rows alike in id and text share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def all_marks(docs: DataFrame) -> DataFrame:
    """k, lo, hi, off, mark, around, c, places: first and last window of a mark, its place behind lo, hashes of the piece and of all that its windows cover.

    Marks of one document with equal surroundings, as in text of one period,
    are one row: c counts them and ``places`` has the ranges of their windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slab(keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in blobs])
            whole = b"".join(blobs)
            at, h, lo, hi = marks(np.frombuffer(whole, np.uint8), ends)
            doc = np.searchsorted(ends, at, "right")
            off = at - lo
            digests = b"".join(xxhash.xxh3_128_digest(whole[a:b], p) for a, b, p in zip(lo.tolist(), (hi + LENGTH).tolist(), off.tolist(), strict=True))
            around, more = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
            begin = np.append(0, ends[:-1])[doc]
            lo, hi = lo - begin, hi - begin
            by = np.lexsort((lo, more, around, h, doc))
            differ = [x[by][1:] != x[by][:-1] for x in (doc, h, around, more)]
            new = np.append(True, np.logical_or.reduce(differ)) if len(by) else np.zeros(0, np.bool_)
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(by)))
            places: list[list[dict] | None] = [None] * len(head)
            for i in np.flatnonzero(count > 1).tolist():
                m = by[head[i] : head[i] + count[i]]
                cut = np.flatnonzero(lo[m][1:] > hi[m][:-1] + 1) + 1
                places[i] = [{"lo": a, "hi": b} for a, b in zip(lo[m][np.append(0, cut)].tolist(), hi[m][np.append(cut - 1, len(m) - 1)].tolist(), strict=True)]
            one = by[head]
            cols = [np.array(keys, np.int64)[doc[one]], *(x[one].astype(np.int32) for x in (lo, hi, off)), *(np.ascontiguousarray(x[one]).view(np.int64) for x in (h, around, more)), count.astype(np.int32)]
            ranges = pa.array(places, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), ranges], names=["k", "lo", "hi", "off", "mark", "around", "more", "c", "places"])

        for b in batches:
            keys, blobs, n = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(t) < LENGTH:
                    continue
                keys.append(k)
                blobs.append(t)
                n += len(t)
                if n > SLAB:
                    yield slab(keys, blobs)
                    keys, blobs, n = [], [], 0
            if blobs:
                yield slab(keys, blobs)

    long = docs.where(F.octet_length("text") >= LENGTH).select(_key().alias("k"), F.encode("text", "UTF-8").alias("t"))
    return long.mapInArrow(run, "k long, lo int, hi int, off int, mark long, around long, more long, c int, places array<struct<lo:int,hi:int>>")


_GROUP = "g long, k long, base int, off int, core int, need boolean, bytes binary"


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["g", "k", "base", "off", "core", "need", "bytes"])


def _surroundings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """g (the group, at first the mark), k, base (where they begin), off and core (where the common piece is in them), need, bytes: what the windows of the marks asked for cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield _groups([(m["mark"], k, m["lo"], m["off"], ANCHOR, m["need"], t[m["lo"] : m["hi"] + LENGTH]) for k, t, found in texts for m in found])

    by = asked.groupBy("k").agg(F.collect_set(F.struct("lo", "hi", "off", "mark", "need")).alias("found"))
    long = docs.where(F.octet_length("text") >= LENGTH).select(_key().alias("k"), "text")
    # rows alike in id and text are one
    j = long.join(by, "k").dropDuplicates(["k"]).select("k", F.encode("text", "UTF-8").alias("t"), "found")
    return j.mapInArrow(run, _GROUP)


def halves(g: int, k: int, base: int, off: int, core: int, need: bool, text: bytes) -> list[tuple]:
    """The surroundings as members of up to two smaller groups.

    Windows that hold at least half of their other bytes behind the common
    piece share a longer piece to the right, all others one to the left.
    """
    rest = LENGTH - core
    if rest == 0:
        return []
    h = -(-rest // 2)
    last, cut = len(text) - LENGTH, off + core - LENGTH + h
    out = []
    if (a := max(0, cut)) <= last:
        name = xxhash.xxh3_64_intdigest(text[off : off + core + h], g & 0x7FFFFFFFFFFFFFFF) - (1 << 63)
        out.append((name, k, base + a, off - a, core + h, need, text[a:]))
    if (b := min(last, cut - 1)) >= 0:
        more = rest - h + 1
        name = xxhash.xxh3_64_intdigest(text[off - more : off + core], ~g & 0x7FFFFFFFFFFFFFFF) - (1 << 63)
        out.append((name, k, base, off - more, core + more, need, text[: b + LENGTH]))
    return out


def _split(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts of groups that are too large, of several different members each, and the ranges of places settled by equal members of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _groups([x for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True) for x in halves(*r)])

    parts = scratch.table(hot.select("g", "k", "base", "off", "core", "need", "bytes").mapInArrow(run, _GROUP), "group-parts")
    each = parts.groupBy("g", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("k", "base", "off", "core", "need")).alias("one"))
    again = each.where("n > 1").select("g", "bytes")
    settled = parts.where("need").join(again, ["g", "bytes"]).select("k", F.col("base").alias("lo"), (F.col("base") + F.octet_length("bytes") - LENGTH).alias("hi"))
    several = each.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    left = each.join(several, "g").select("g", "one.k", "one.base", "one.off", "one.core", (F.col("one.need") & (F.col("n") == 1)).alias("need"), "bytes")
    return scratch.table(left, "groups"), scratch.table(settled, "settled")


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Successive numbers as (first, last)."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return list(zip(starts[np.append(0, cut)].tolist(), starts[np.append(cut - 1, len(starts) - 1)].tolist(), strict=True))


def repeated_windows(texts: list[bytes], ident: np.ndarray, base: np.ndarray, folder: str | None = None) -> list[np.ndarray]:
    """For each text the starts of its windows that another place has too; ident and base tell which places are the same.

    Suffixes come in order, block by block.  Those with LENGTH bytes in common
    with the one before are of its group; a group is repeated once it has two
    different places, until when only its first members are held.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    t = np.frombuffer(b"".join(texts), np.uint8)
    if len(t) < LENGTH:
        return [np.zeros(0, np.int64) for _ in texts]
    begin = np.append(0, np.cumsum(sizes)[:-1])
    owners, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def settle(owner: np.ndarray, inside: np.ndarray, group: np.ndarray) -> None:
        """The members of whole groups that have two different places at least."""
        place = np.stack([ident[owner], base[owner] + inside], axis=1)
        first = np.searchsorted(group, group)
        other = (place != place[first]).any(axis=1)
        hit = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.bool_)
        hit[group[other]] = True
        good = hit[group]
        owners.append(owner[good])
        starts.append(inside[good])

    held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for pos, common in suffixes(t, folder=folder):
        owner = np.searchsorted(begin, pos, "right") - 1
        inside = pos - begin[owner]
        whole = inside + LENGTH <= sizes[owner]
        group = np.cumsum(common < LENGTH)
        owner, inside, group = (np.concatenate([h, x[whole]]) for h, x in zip((*held, np.zeros(len(held[0]), np.int64)), (owner, inside, group), strict=True))
        # the last group may go on in the next block; of one that is known to be repeated two members stand for it
        last = np.searchsorted(group, int(np.cumsum(common < LENGTH)[-1]))
        settle(owner[:last], inside[:last], group[:last])
        held = owner[last:], inside[last:]
        if len(held[0]) > 2:
            place = np.stack([ident[held[0]], base[held[0]] + held[1]], axis=1)
            other = np.flatnonzero((place != place[0]).any(axis=1))
            if len(other):
                settle(*held, np.zeros(len(held[0]), np.int64))
                held = tuple(x[[0, other[0]]] for x in held)
    settle(*held, np.zeros(len(held[0]), np.int64))
    o, s = np.concatenate(owners), np.concatenate(starts)
    by = np.argsort(o, kind="stable")
    o, s = o[by], s[by]
    edge = np.searchsorted(o, np.arange(len(texts) + 1))
    return [np.unique(s[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _shard(table: pa.Table, folder: str | None = None) -> pa.Table:
    texts = table["bytes"].to_pylist()
    k, base, need = (np.asarray(table[c]) for c in ("k", "base", "need"))
    rows = []
    for i, starts in enumerate(repeated_windows(texts, k, base.astype(np.int64), folder)):
        if need[i] and len(starts):
            rows += [(int(k[i]), int(base[i]) + a, int(base[i]) + b) for a, b in _runs(starts)]
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["k", "lo", "hi"])


def _by_shards(groups: DataFrame) -> DataFrame:
    size = groups.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(64, -(-size // SHARD))
    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).repartition(min(shards, 4096), "shard")
    folder = scratch.place(groups.sparkSession, "suffix-queues")
    return dealt.groupBy("shard").applyInArrow(lambda t: _shard(t, folder), "k long, lo int, hi int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """k, lo, hi: ranges of places at which a repeated string of LENGTH bytes starts."""
    found = scratch.table(all_marks(docs), "marks")
    again = found.groupBy("mark").agg(F.sum("c").alias("n")).where("n > 1").select("mark")
    # marks that occur once, nearly all of them, go before anything else is done; rows alike in id and text have equal marks, which are one from here
    twice = found.join(again, "mark").groupBy("k", "lo", "hi", "off", "mark", "around", "more").agg(F.sum("c").alias("c"), F.first("places").alias("places"))
    twice = scratch.table(twice, "marks-again")
    scratch.drop(found)
    each = twice.groupBy("mark", "around", "more").agg(F.sum("c").alias("n"), F.min(F.struct("k", "lo")).alias("first"))
    kinds = each.groupBy("mark").agg(F.count("*").alias("kinds"))
    j = twice.join(each.join(kinds, "mark"), ["mark", "around", "more"])
    j = scratch.table(j.select("k", "lo", "hi", "off", "places", "mark", "n", "kinds", (F.struct("k", "lo") == F.col("first")).alias("leads")), "repeated-marks")
    scratch.drop(twice)
    # all windows of a mark whose surroundings occur again
    out = j.where("n > 1").select("k", F.explode(F.coalesce("places", F.array(F.struct("lo", "hi")))).alias("r")).select("k", "r.lo", "r.hi")
    asked = j.where("leads and kinds > 1").select("k", "lo", "hi", "off", "mark", (F.col("n") == 1).alias("need"))
    groups = scratch.table(_surroundings(docs, asked), "groups")
    while True:
        large = groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("g")
        out = out.unionByName(_by_shards(groups.join(large, "g", "left_anti")))
        hot = groups.join(large, "g", "left_semi")
        if hot.limit(1).count() == 0:
            return out
        groups, settled = _split(hot)
        out = out.unionByName(settled)


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            for t, lo, hi in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                out, last, gone, runs = [], 0, 0, 0
                if lo:
                    a = np.array(lo, np.int64)
                    e = np.array(hi, np.int64) + LENGTH
                    by = np.argsort(a, kind="stable")
                    a, e = a[by], np.maximum.accumulate(e[by])
                    cut = np.flatnonzero(a[1:] > e[:-1]) + 1
                    for x, y in zip(a[np.append(0, cut)].tolist(), e[np.append(cut - 1, len(e) - 1)].tolist(), strict=True):
                        out.append(t[last:x])
                        last, gone, runs = y, gone + y - x, runs + 1
                out.append(t[last:])
                rest = b"".join(out)
                n_bytes.append(len(t))
                removed.append(gone)
                spans.append(runs)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    where = repeated_starts(docs).groupBy("k").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    j = docs.withColumn("k", _key()).join(where, "k", "left").select("doc_id", F.encode("text", "UTF-8").alias("t"), "lo", "hi")
    out = j.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
