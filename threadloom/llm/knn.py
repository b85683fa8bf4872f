"""Exact top-k inner-product search by a Voronoi kNN join.

The largest inner products are the smallest distances once every data vector
gets one more component that brings all of them to the same norm, and every
query a zero there.  In that space queries and data are grouped by their
nearest pivots, whose number grows with the root of the table.

Every query first meets some data of its home cell, a bounded sample, which
gives a floor under its k-th score.  Summaries of a cell's queries (how far
they lie from the pivots, and the distance of the lowest floor) then bound where
a vector must lie to matter to any of them: for each pivot in a ring.  A data
vector goes only to groups of cells whose rings it passes; cells are put into
one group where they need the same vectors anyway.  A group is solved in chunks
that its need calls for, and a chunk tells only of scores that reach the
floors, so neither vectors nor results are sent in vain.

A cell with a third of all vectors is no hot spot: its queries are split into
blocks and its data are dealt to chunks by a hash.  Where nothing can be
pruned, as among directions without clusters, every block of queries meets
every chunk of data, once.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without an id; shorter vectors count as
padded with zeros; ties go to the smaller id; a query meets all rows but its
own, also others of its id; repeated vectors are ranked each; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Pivots at least and at most, and how many of them bound rings.
PIVOTS, MOST_PIVOTS, RINGS = 16, 2048, 48
#: Queries of one block and data vectors of one chunk, which bound what a task holds.
BLOCK, CHUNK = 4096, 16384
#: Data vectors of a cell from which floors are taken; any would give a valid floor.
HOME = 2048
#: Data vectors on which groups are planned; whatever the plan, the result is the same.
PLANNED_ON = 4096
#: Cost of scoring a vector for one query, in units of sending it.
SCORING = 0.02
_NONE = np.iinfo(np.int64).min


def quantize(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length ``dim``, zeros where a vector is shorter."""
    values, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    length = np.diff(offsets)
    if len(length) and (length == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(length), dim), np.int64)
    for i, n in enumerate(length):
        out[i, :n] = values[offsets[i] - offsets[0] : offsets[i] - offsets[0] + n]
    return out


class _Space:
    """Distances to the pivots in the space in which inner products are distances."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.p, self.most = pivots.astype(np.float64), most
        self.p_last = np.sqrt(np.maximum(0.0, most - (self.p**2).sum(1)))

    def data(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        last = np.sqrt(np.maximum(0.0, self.most - (x**2).sum(1)))
        return np.sqrt(np.maximum(0.0, 2 * self.most - 2 * (x @ self.p.T + last[:, None] * self.p_last[None, :])))

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + self.most - 2 * (x @ self.p.T)))


def _spread(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _sizes(vecs: DataFrame, space: _Space, dim: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Data vectors of each cell, and queries whose nearest pivot is the cell's."""
    pivots = len(space.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asked = np.zeros(pivots, np.int64), np.zeros(pivots, np.int64)
        for b in batches:
            x, ids = _matrix(b.column(2), dim), np.asarray(b.column(1))
            n += np.bincount(space.data(x).argmin(1), minlength=pivots)
            ask = ids % every == 0
            if ask.any():
                asked += np.bincount(space.queries(x[ask]).argmin(1), minlength=pivots)
        at = np.flatnonzero(n + asked)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(asked[at])], names=["cell", "n", "asked"])

    n, asked = np.zeros(pivots, np.int64), np.zeros(pivots, np.int64)
    for r in vecs.mapInArrow(run, "cell int, n long, asked long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect():
        n[r.cell], asked[r.cell] = r.n, r.asked
    return n, asked


def _floors(vecs: DataFrame, space: _Space, dim: int, k: int, every: int, n: np.ndarray, asked: np.ndarray) -> DataFrame:
    """query (its row), query_id, v, cell, floor: each query with its home cell and its k-th score in a sample of it."""
    # a cell with few vectors is nobody's home, unless all are
    home = n >= min(4 * k, n.max())
    share = np.minimum(1.0, HOME / np.maximum(n, 1))
    # queries that leave a small cell go to one of the others, which may have more then
    split = np.maximum(1, -(-(asked + asked[~home].sum()) // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), dim)
            dice = _spread(rows)
            cell = space.data(x).argmin(1)
            kept = np.flatnonzero(home[cell] & (dice.astype(np.float64) / float(1 << 31) < share[cell]))
            times = split[cell[kept]]
            at = np.repeat(kept, times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            ask = np.flatnonzero(ids % every == 0)
            own = np.where(home, space.queries(x[ask]), np.inf).argmin(1)
            cells = np.concatenate([cell[at], own]).astype(np.int32)
            parts = np.concatenate([part, (dice[ask] % split[own].astype(np.uint64)).astype(np.int64)])
            asks = np.append(np.zeros(len(at), np.bool_), np.ones(len(ask), np.bool_))
            every_one = np.append(at, ask)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(parts), pa.array(asks), pa.array(rows[every_one]), pa.array(ids[every_one]), _lists(x[every_one])], names=["cell", "part", "asks", "row", "vec_id", "v"])

    def solve(t: pa.Table) -> pa.Table:
        asks = np.asarray(t["asks"])
        rows, x = np.asarray(t["row"]), _matrix(t["v"].combine_chunks(), dim)
        q, own, data, seen = x[asks], rows[asks], x[~asks], rows[~asks]
        floor = np.full(len(q), _NONE)
        for lo in range(0, len(q) if len(data) >= k else 0, 512):
            scores = _scores(q[lo : lo + 512], data, space.most)
            scores[own[lo : lo + 512, None] == seen[None, :]] = _NONE
            floor[lo : lo + 512] = np.partition(scores, len(data) - k, axis=1)[:, len(data) - k]
        mine = t.filter(pa.array(asks))
        return pa.table([mine["row"], mine["vec_id"], mine["v"], mine["cell"], pa.array(floor)], names=["query", "query_id", "v", "cell", "floor"])

    dealt = vecs.mapInArrow(deal, "cell int, part long, asks boolean, row long, vec_id long, v array<long>")
    return dealt.groupBy("cell", "part").applyInArrow(solve, "query long, query_id long, v array<long>, cell int, floor long")


def _scores(q: np.ndarray, data: np.ndarray, most: float) -> np.ndarray:
    """Inner products, exact: as doubles while these hold them."""
    return (q.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64) if most < 2.0**52 else q @ data.T


@dataclass
class Rings:
    """For each cell with queries: their number, and the least and largest distance from the ring pivots at which a vector matters to one."""

    cells: np.ndarray
    asked: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own_low: np.ndarray
    own_high: np.ndarray

    def need(self, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether vectors, by their distances to all pivots, matter to any of the cells at the places ``at``."""
        out = np.zeros(len(d), np.bool_)
        ring = d[:, : self.low.shape[1]]
        for i in at:
            own = d[:, self.cells[i]]
            todo = np.flatnonzero(~out & (own >= self.own_low[i]) & (own <= self.own_high[i]))
            out[todo] = ((ring[todo] >= self.low[i]) & (ring[todo] <= self.high[i])).all(1)
        return out


def _rings(asks: DataFrame, space: _Space, dim: int) -> Rings:
    rings, slack = min(RINGS, len(space.p)), 1e-6 * np.sqrt(space.most) + 1e-6
    schema = "cell int, n long, low array<double>, high array<double>, own_low double, own_high double"

    def table(cells: list[int], n: list[int], low: list[np.ndarray], high: list[np.ndarray], own_low: list[float], own_high: list[float]) -> pa.Table:
        arrays = [pa.array(cells, pa.int32()), pa.array(n, pa.int64()), *(pa.array([list(x) for x in y], pa.list_(pa.float64())) for y in (low, high)), *(pa.array(y, pa.float64()) for y in (own_low, own_high))]
        return pa.table(arrays, names=["cell", "n", "low", "high", "own_low", "own_high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, floor = _matrix(b.column(0), dim), np.asarray(b.column(1)), np.asarray(b.column(2))
            d = space.queries(x)
            # the distance at which a vector has the floor as its score
            squared = (x.astype(np.float64) ** 2).sum(1) + space.most - 2.0 * floor.astype(np.float64)
            reach = np.where(floor == _NONE, np.inf, np.sqrt(np.maximum(0.0, squared))) + slack
            low, high = d - reach[:, None], d + reach[:, None]
            cells = np.unique(cell)
            rows = [np.flatnonzero(cell == c) for c in cells]
            each = [(int(c), len(r), low[r, :rings].min(0), high[r, :rings].max(0), float(low[r, c].min()), float(high[r, c].max())) for c, r in zip(cells, rows, strict=True)]
            yield from table(*map(list, zip(*each, strict=True))).to_batches() if each else []

    def merge(t: pa.Table) -> pa.Table:
        low, high = (np.array(t[c].to_pylist()) for c in ("low", "high"))
        return table([t["cell"][0].as_py()], [sum(t["n"].to_pylist())], [low.min(0)], [high.max(0)], [min(t["own_low"].to_pylist())], [max(t["own_high"].to_pylist())])

    got = asks.select("v", "cell", "floor").mapInArrow(run, schema).groupBy("cell").applyInArrow(merge, schema).collect()
    got = sorted(got, key=lambda r: r.cell)
    col = lambda c, kind=float: np.array([r[c] for r in got], kind)
    return Rings(col("cell", np.int64), col("n", np.int64), col("low").reshape(-1, rings), col("high").reshape(-1, rings), col("own_low"), col("own_high"))


def _groups(rings: Rings, d: np.ndarray, between: np.ndarray, n: int) -> tuple[list[list[int]], list[float]]:
    """Groups of places in ``rings``, and the share of all vectors that each needs, from a sample's distances ``d``.

    Cells are joined, each with the group whose pivots are nearest first, as
    long as sending and scoring what both need together costs less than doing so apart.
    """
    need = np.array([rings.need(d, [i]) for i in range(len(rings.cells))]).reshape(len(rings.cells), len(d))
    cost = lambda share, asked: share * n * (1 + SCORING * asked)
    groups: list[list[int]] = []
    unions: list[np.ndarray] = []
    asked: list[int] = []
    for i in np.argsort(-need.sum(1), kind="stable").tolist():
        mine, q = need[i], int(rings.asked[i])
        best, at = 0.0, None
        for g in sorted(range(len(groups)), key=lambda g: between[rings.cells[i], rings.cells[groups[g][0]]])[:8]:
            if asked[g] + q > BLOCK:
                continue
            both = unions[g] | mine
            saved = cost(unions[g].mean(), asked[g]) + cost(mine.mean(), q) - cost(both.mean(), asked[g] + q)
            if saved > best:
                best, at = saved, g
        if at is None:
            groups.append([i])
            unions.append(mine.copy())
            asked.append(q)
        else:
            groups[at].append(i)
            unions[at] |= mine
            asked[at] += q
    return groups, [float(u.mean()) if len(u) else 1.0 for u in unions]


def _best(scores: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the positions of its best k in a chunk whose ids ascend, of those that reach its floor."""
    n = scores.shape[1]
    if n > k:
        floor = np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
    floor = np.maximum(floor, _NONE + 1)
    hit = scores >= floor[:, None]
    for i in np.flatnonzero(hit.any(1)):
        at = np.flatnonzero(hit[i])
        yield i, at[np.argsort(-scores[i, at], kind="stable")[:k]]


@dataclass
class Join:
    """The parts of one search: vectors sent to (group, block, chunk), and how they are solved."""

    dealt: DataFrame
    result: DataFrame
    groups: int
    #: Sum over groups of the share of vectors planned to be sent.
    share: float


def join(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> Join | None:
    vecs = scratch.table(quantize(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "knn-vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, dim, n = vecs.agg(F.max(squares), F.max(F.size("v")), F.count("*")).first()
    if not n:
        return None

    def sample(size: int, seed: int) -> np.ndarray:
        out = [r.v for r in vecs.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(size).collect()]
        return _matrix(pa.array(out, pa.list_(pa.int64())), dim)

    space = _Space(np.unique(sample(int(min(MOST_PIVOTS, max(PIVOTS, n**0.5))), 1), axis=0), most)
    sizes, asked = _sizes(vecs, space, dim, every)
    asks = scratch.table(_floors(vecs, space, dim, k, every, sizes, asked), "knn-queries")
    rings = _rings(asks, space, dim)
    groups, shares = _groups(rings, space.data(sample(PLANNED_ON, 2)), space.data(space.p), n)
    group_of = np.zeros(len(space.p), np.int64)
    for g, held in enumerate(groups):
        group_of[rings.cells[held]] = g
    blocks = np.array([max(1, -(-int(rings.asked[held].sum()) // BLOCK)) for held in groups], np.int64)
    chunks = np.array([max(1, -(-int(1.1 * share * n) // CHUNK)) for share in shares], np.int64)
    # a small search is spread over more tasks
    chunks = np.maximum(chunks, -(-32 // max(1, len(groups))))
    out = "grp int, block long, chunk long, asks boolean, row long, vec_id long, v array<long>, floor long"

    def batch(g: np.ndarray, block: np.ndarray, chunk: np.ndarray, asks: bool, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 20_000):
            s = slice(lo, lo + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(g[s].astype(np.int32)), pa.array(block[s]), pa.array(chunk[s]), pa.array(np.full(len(rows[s]), asks)), pa.array(rows[s]), pa.array(ids[s]), _lists(x[s]), pa.array(floor[s])], names=["grp", "block", "chunk", "asks", "row", "vec_id", "v", "floor"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), dim)
            d, dice = space.data(x), _spread(rows).astype(np.int64)
            for g, held in enumerate(groups):
                need = np.flatnonzero(rings.need(d, held))
                for block in range(blocks[g]):
                    yield from batch(np.full(len(need), g), np.full(len(need), block), dice[need] % chunks[g], False, rows[need], ids[need], x[need], np.zeros(len(need), np.int64))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), dim)
            g = group_of[np.asarray(b.column(3))]
            times = chunks[g]
            at = np.repeat(np.arange(len(rows)), times)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            block = _spread(rows).astype(np.int64) % blocks[g]
            yield from batch(g[at], block[at], chunk, True, rows[at], ids[at], x[at], np.asarray(b.column(4))[at])

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("vec_id")
        asks = np.asarray(t["asks"])
        rows, ids, floors, x = np.asarray(t["row"]), np.asarray(t["vec_id"]), np.asarray(t["floor"]), _matrix(t["v"].combine_chunks(), dim)
        q, own, asked_id, floor, data, seen, their = x[asks], rows[asks], ids[asks], floors[asks], x[~asks], rows[~asks], ids[~asks]
        qs, qi, vs, ss = [], [], [], []
        for lo in range(0, len(q) if len(data) else 0, 512):
            scores = _scores(q[lo : lo + 512], data, most)
            scores[own[lo : lo + 512, None] == seen[None, :]] = _NONE
            for i, at in _best(scores, floor[lo : lo + 512], k):
                qs.append(np.full(len(at), own[lo + i]))
                qi.append(np.full(len(at), asked_id[lo + i]))
                vs.append(their[at])
                ss.append(scores[i, at])
        cat = lambda a: pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(qs), cat(qi), cat(vs), cat(ss)], names=["query", "query_id", "vec_id", "score"])

    dealt = vecs.mapInArrow(deal, out).unionByName(asks.select("query", "query_id", "v", "cell", "floor").mapInArrow(ask, out))
    local = dealt.groupBy("grp", "block", "chunk").applyInArrow(solve, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    ranked = local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return Join(dealt, ranked, len(groups), sum(shares))


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for each vector whose id ``every`` divides, against all other rows."""
    found = join(vectors, k, scale, every)
    return found.result if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
