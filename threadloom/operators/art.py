"""Two-level online clustering of a topic's memories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..catalog import query
from ..config import DEFAULT, Art
from ..plans.fold import keyed_fold
from ..sources.fixtures import MEMORIES, TURNS, mean_of, memories, turns, unit
from ..sources.views import once
from .segments import direction
from .vectors import BLOCK

_COS = "list_cosine_similarity"


def py_blend(a: np.ndarray, b: np.ndarray, beta: float) -> np.ndarray:
    return direction(a * (1 - beta) + b * beta)


class Centroids:
    """Vectors that are held against another one all at once."""

    def __init__(self):
        self.n, self.rows, self.units = 0, np.zeros((0, 0)), np.zeros((0, 0))

    def put(self, at: int, v: np.ndarray) -> None:
        if at == self.n:
            if self.n == len(self.rows):
                size = max(8, 2 * self.n)
                self.rows, self.units = (np.vstack([x.reshape(-1, len(v)), np.zeros((size - len(x), len(v)))]) for x in (self.rows, self.units))
            self.n += 1
        self.rows[at], self.units[at] = v, direction(v)

    def likeness(self, v: np.ndarray) -> np.ndarray:
        return self.units[: self.n] @ direction(v)


class Map:
    """Categories and bundles of one topic, numbered from 1."""

    def __init__(self, anchor: str):
        self.anchor = anchor
        self.categories, self.bundles = Centroids(), Centroids()
        #: the bundle of each category
        self.home: list[int] = []
        self.last_bundle: int | None = None


def _nearest(c: Centroids, vec: np.ndarray) -> tuple[int, float]:
    """Place and likeness of the nearest, the first on a tie; -1 if there are none."""
    if not c.n:
        return -1, -2.0
    sims = c.likeness(vec)
    at = int(sims.argmax())
    return at, float(sims[at])


def _assign_bundle(s: Map, cat: int, cfg: Art) -> int:
    """The category's own bundle while it fits, else the nearest that does, else a new one."""
    centroid = s.categories.rows[cat]
    current = s.home[cat] - 1
    if current >= 0 and float(s.bundles.units[current] @ direction(centroid)) >= cfg.bundle_at:
        s.bundles.put(current, py_blend(s.bundles.rows[current], centroid, cfg.bundle_beta))
        return current + 1
    best, sim = _nearest(s.bundles, centroid)
    if best >= 0 and sim >= cfg.bundle_at:
        # joining blends once for the category and once for the move
        s.bundles.put(best, py_blend(py_blend(s.bundles.rows[best], centroid, cfg.bundle_beta), centroid, cfg.bundle_beta))
        return best + 1
    s.bundles.put(s.bundles.n, centroid)
    return s.bundles.n


def art_step(cfg: Art):
    """Where one memory goes: category and bundle, whether they are new, and the bundle inserted into before."""

    def step(s: Map, row: dict) -> list[tuple]:
        vec = np.asarray(row["vec"], np.float64)
        cat, sim = _nearest(s.categories, vec)
        new = cat < 0 or sim < cfg.category_at
        if new:
            cat, sim = s.categories.n, 1.0
            s.categories.put(cat, vec)
            s.home.append(0)
        else:
            s.categories.put(cat, py_blend(s.categories.rows[cat], vec, cfg.category_beta))
            sim = float(s.categories.units[cat] @ direction(vec))
        before = s.bundles.n
        bundle = s.home[cat] = _assign_bundle(s, cat, cfg)
        linked = s.last_bundle if s.last_bundle not in (None, bundle) else None
        s.last_bundle = bundle
        return [(s.anchor, row["turn"], row["mem_id"], cat + 1, bundle, new, s.bundles.n > before, sim, linked)]

    return step


#: Tasks among which topics and their blocks are dealt, at least; several for each core, since they are large and few.
DEALT = 48


def dealt(spark: SparkSession) -> int:
    return max(DEALT, int(spark.conf.get("spark.sql.shuffle.partitions")))


ART_SCHEMA = "anchor string, turn long, mem_id long, category long, bundle long, new_category boolean, new_bundle boolean, score double, linked_from long"


def art_map(mem: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    return keyed_fold(mem.select("anchor", "turn", "mem_id", "vec"), "anchor", ["turn", "mem_id"], Map, art_step(cfg), ART_SCHEMA, tasks=dealt(mem.sparkSession))


def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"


def _blend_sql(a: str, b: str, beta: float) -> str:
    return f"list_transform(range(1, 65), lambda i: {a}[i] * {1 - beta!r} + {b}[i] * {beta!r})"


def art_sql(mem: str) -> str:
    """The map as a recursive query, one step a memory, as ``art``."""
    return f"""ax AS (SELECT anchor, turn, mem_id, vec, row_number() OVER (PARTITION BY anchor ORDER BY turn, mem_id) AS n FROM {mem}),
art AS MATERIALIZED (WITH RECURSIVE f AS (
  SELECT anchor, n, turn, mem_id, 1 AS category, 1 AS bundle, true AS new_category, true AS new_bundle, 1.0::DOUBLE AS score, NULL::INT AS linked_from, [{{'c': vec, 'b': 1}}] AS cats, [vec] AS buns FROM ax WHERE n = 1
  UNION ALL
  SELECT anchor, n, turn, mem_id, cid, bid, fresh, bid > len(buns), score, CASE WHEN old <> bid THEN old END,
    CASE WHEN fresh THEN list_append(cats, {{'c': cc, 'b': bid}}) ELSE list_transform(cats, lambda k, i: CASE WHEN i = cid THEN {{'c': cc, 'b': bid}} ELSE k END) END,
    CASE WHEN bid > len(buns) THEN list_append(buns, cc) ELSE list_transform(buns, lambda k, i: CASE WHEN i = bid THEN bc ELSE k END) END
  FROM (SELECT *, CASE WHEN own THEN u1 ELSE u2 END AS bc FROM (SELECT *, {_unit_sql('b2')} AS u2 FROM (
   SELECT *, {_blend_sql('u1','cc',0.18)} AS b2 FROM (SELECT *, {_unit_sql('b1')} AS u1 FROM (
    SELECT *, {_blend_sql('bbase','cc',0.18)} AS b1 FROM (SELECT *, CASE WHEN bid <= len(buns) THEN buns[bid] ELSE cc END AS bbase FROM (
     SELECT *, CASE WHEN own THEN was WHEN bm >= 0.82 THEN list_position(bs, bm) ELSE len(buns) + 1 END AS bid, NOT own AND bm >= 0.82 AS joins FROM (
      SELECT *, list_max(bs) AS bm, coalesce({_COS}(cc, buns[was]) >= 0.82, false) AS own FROM (
       SELECT *, list_transform(buns, lambda k: {_COS}(k, cc)) AS bs, CASE WHEN fresh THEN 1.0 ELSE {_COS}(cc, vec) END AS score, cats[cid].b AS was FROM (
        SELECT *, CASE WHEN fresh THEN vec ELSE c2 END AS cc FROM (SELECT *, {_unit_sql('c1')} AS c2 FROM (
         SELECT *, {_blend_sql('base','vec',0.28)} AS c1 FROM (SELECT *, CASE WHEN fresh THEN vec ELSE cats[cid].c END AS base FROM (
          SELECT *, list_max(cs) < 0.88 AS fresh, CASE WHEN list_max(cs) < 0.88 THEN len(cats) + 1 ELSE list_position(cs, list_max(cs)) END AS cid FROM (
           SELECT f.anchor, x.n, x.turn, x.mem_id, x.vec, cats, buns, bundle AS old, list_transform(cats, lambda k: {_COS}(k.c, x.vec)) AS cs FROM f JOIN ax x ON x.anchor = f.anchor AND x.n = f.n + 1))))))))))))))))
  SELECT anchor, turn, mem_id, category, bundle, new_category, new_bundle, score, linked_from FROM f)"""


_ART = f"WITH {TURNS}, {MEMORIES}, {art_sql('mem')}"


def _art(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The memories and their map, which is written: what reads it more than once would fold every topic as often."""
    mem = memories(turns(spark, sf_dir))
    return mem, once(spark, sf_dir, "art-map", lambda: art_map(mem))


@query("a1_categories", f"{_ART}, x AS (SELECT *, row_number() OVER (PARTITION BY anchor, category ORDER BY round(score, 9) DESC, mem_id) AS k FROM art) SELECT anchor, category, count(*) AS support, max(turn) AS last_turn, list(mem_id ORDER BY k) FILTER (WHERE k <= 12) AS exemplars FROM x GROUP BY ALL")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with their support and their twelve best exemplars."""
    _, a = _art(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("anchor", "category").orderBy(F.round("score", 9).desc(), "mem_id"))
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= DEFAULT.art.exemplars, F.struct("n", "mem_id")))), lambda s: s["mem_id"])
    return a.withColumn("n", n).groupBy("anchor", "category").agg(F.count("*").alias("support"), F.max("turn").alias("last_turn"), best.alias("exemplars"))


@query("a2_bundles", f"{_ART} SELECT anchor, bundle, list_sort(list(DISTINCT category)) AS categories, count(*) AS inserts, max(turn) AS last_turn FROM art GROUP BY ALL")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = _art(spark, sf_dir)
    return a.groupBy("anchor", "bundle").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("inserts"), F.max("turn").alias("last_turn"))


def bundle_links(a: DataFrame) -> DataFrame:
    """anchor, bundle, other, weight: consecutive inserts into two bundles link them both ways."""
    l = a.where("linked_from is not null").select("anchor", F.col("linked_from").alias("bundle"), F.col("bundle").alias("other"))
    both = l.unionByName(l.select("anchor", F.col("other").alias("bundle"), F.col("bundle").alias("other")))
    return both.groupBy("anchor", "bundle", "other").agg(F.count("*").cast("double").alias("weight"))


_LINKS = "lk AS (SELECT anchor, bundle, other, count(*)::DOUBLE AS weight FROM (SELECT anchor, linked_from AS bundle, bundle AS other FROM art WHERE linked_from IS NOT NULL UNION ALL SELECT anchor, bundle, linked_from FROM art WHERE linked_from IS NOT NULL) GROUP BY ALL)"


@query("a3_bundle_links", f"{_ART}, {_LINKS} SELECT anchor, bundle, other, weight FROM lk")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_links(_art(spark, sf_dir)[1])


@query("a3_links_given", f"WITH {TURNS}, {MEMORIES}, l AS (SELECT anchor, cluster_id AS b, lag(cluster_id) OVER (PARTITION BY anchor ORDER BY turn) AS p FROM mem), x AS (SELECT anchor, p AS bundle, b AS other FROM l WHERE p <> b UNION ALL SELECT anchor, b, p FROM l WHERE p <> b) SELECT anchor, bundle, other, count(*)::DOUBLE AS weight FROM x GROUP BY ALL")
def a3_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links for an assignment that is given, the clusters."""
    prev = F.lag("cluster_id").over(Window.partitionBy("anchor").orderBy("turn"))
    a = memories(turns(spark, sf_dir)).select("anchor", F.col("cluster_id").alias("bundle"), prev.alias("p"))
    return bundle_links(a.withColumn("linked_from", F.when(F.col("p") != F.col("bundle"), F.col("p"))))


def exemplars(assigned: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    """anchor, category, mem_id, stored: the twelve memories of each category that were most like it when they came."""
    n = F.row_number().over(Window.partitionBy("anchor", "category").orderBy(F.round("score", 9).desc(), "mem_id"))
    return assigned.withColumn("n", n).where(F.col("n") <= cfg.exemplars).select("anchor", "category", "mem_id", F.col("score").alias("stored"))


def _centroids(mem: DataFrame, assigned: DataFrame, level: str) -> DataFrame:
    j = mem.select("mem_id", "vec").where(F.size("vec") > 0).join(assigned.select("mem_id", "anchor", level), "mem_id")
    return j.groupBy("anchor", level).agg(unit(mean_of("vec")).alias("centroid"))


#: Rows of a topic's map as its queries get them: what ``kind`` says about ``a``, with another number, a weight and a vector.
_BUNDLE, _CATEGORY, _HELD, _HOME, _LINK, _EXEMPLAR = range(6)


def map_rows(mem: DataFrame, assigned: DataFrame, links: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    """anchor, kind, a, b, w, v: centroids, the categories that each bundle ever held, the last bundle of each category, links, exemplars."""
    none = {"a": F.lit(None).cast("long"), "b": F.lit(None).cast("long"), "w": F.lit(None).cast("double"), "v": F.lit(None).cast("array<double>")}

    def rows(df: DataFrame, kind: int, **named: str) -> DataFrame:
        return df.select("anchor", F.lit(kind).alias("kind"), *[(F.col(named[k]).cast(mem.schema["vec"].dataType if k == "v" else "double" if k == "w" else "long") if k in named else c).alias(k) for k, c in none.items()])

    home = assigned.groupBy("anchor", "category").agg(F.max_by("bundle", F.struct("turn", "mem_id")).alias("bundle"))
    parts = [
        rows(_centroids(mem, assigned, "bundle"), _BUNDLE, a="bundle", v="centroid"), rows(_centroids(mem, assigned, "category"), _CATEGORY, a="category", v="centroid"),
        rows(assigned.select("anchor", "bundle", "category").distinct(), _HELD, a="bundle", b="category"), rows(home, _HOME, a="category", b="bundle"),
        rows(links, _LINK, a="bundle", b="other", w="weight"), rows(exemplars(assigned, cfg).join(mem.select("mem_id", "vec"), "mem_id"), _EXEMPLAR, a="category", b="mem_id", w="stored", v="vec"),
    ]
    return reduce(DataFrame.unionByName, parts)


def unit_rows(c: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors at length one; zeros for one that is missing or of another length, as such a one is like nothing."""
    c = c.combine_chunks()
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(c), dim), False))
    out = np.zeros((len(c), dim))
    out[fits] = np.asarray(pc.fill_null(c.filter(pa.array(fits)).flatten(), np.nan), np.float64).reshape(-1, dim)
    out[np.isnan(out).any(1)] = 0.0
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def _highest(sims: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k highest of each row, rounded, the first on a tie; -1 where there are no more."""
    sims = np.round(sims, 9)
    out, each = np.full((len(sims), k), -1), np.arange(len(sims))
    for i in range(min(k, sims.shape[1])):
        out[:, i] = sims.argmax(1)
        sims[each, out[:, i]] = -np.inf
    return out


class TopicMap:
    """One topic's map as arrays that many queries are held against at once.

    It holds what the fold that made the map held: a vector for each bundle
    and category, and up to twelve exemplars of each category.
    """

    def __init__(self, t: pa.Table, cfg: Art = DEFAULT.art):
        self.cfg = cfg
        kind = np.asarray(t["kind"])

        def of(k: int, *order: str) -> pa.Table:
            return t.filter(pa.array(kind == k)).sort_by([(c, "ascending") for c in order or ("a",)])

        b, c, e = of(_BUNDLE, "a"), of(_CATEGORY, "a"), of(_EXEMPLAR, "a", "b")
        self.dim = max((pc.max(pc.list_value_length(x["v"].combine_chunks())).as_py() or 0 for x in (b, c) if len(x)), default=0)
        self.bundles, self.bundle_units = np.asarray(b["a"]), unit_rows(b["v"], self.dim)
        self.categories, self.category_units = np.asarray(c["a"]), unit_rows(c["v"], self.dim)
        at_bundle, at_category = ({int(x): i for i, x in enumerate(ids)} for ids in (self.bundles, self.categories))
        self.held: list[list[int]] = [[] for _ in self.bundles]
        h = of(_HELD, "a", "b")
        for x, y in zip(h["a"].to_pylist(), h["b"].to_pylist(), strict=True):
            if x in at_bundle and y in at_category:
                self.held[at_bundle[x]].append(at_category[y])
        self.home = np.zeros(len(self.categories), np.int64)
        h = of(_HOME)
        for x, y in zip(h["a"].to_pylist(), h["b"].to_pylist(), strict=True):
            if x in at_category:
                self.home[at_category[x]] = y
        # the strongest neighbours of each bundle, in the order of their numbers
        self.near, self.near_weight = np.full((len(self.bundles), cfg.neighbours), -1), np.zeros((len(self.bundles), cfg.neighbours))
        strongest: dict[int, list[tuple[float, int, float]]] = {}
        h = of(_LINK)
        for x, y, w in zip(h["a"].to_pylist(), h["b"].to_pylist(), h["w"].to_pylist(), strict=True):
            strongest.setdefault(x, []).append((-round(w, 9), y, w))
        for x, found in strongest.items():
            best = sorted((y, w) for _, y, w in sorted(found)[: cfg.neighbours] if y in at_bundle)
            for i, (y, w) in enumerate(best if x in at_bundle else []):
                self.near[at_bundle[x], i], self.near_weight[at_bundle[x], i] = at_bundle[y], w
        self.exemplars, self.stored, self.exemplar_units = np.asarray(e["b"]), np.asarray(e["w"], np.float64), unit_rows(e["v"], self.dim)
        self.first, self.end = (np.searchsorted(np.asarray(e["a"]), self.categories, side) for side in ("left", "right"))

    def bundles_of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, bundle (as places), likeness and rank of the bundles that each query looks into."""
        cfg, none = self.cfg, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        if not len(self.bundles) or not len(q):
            return none
        bs = q @ self.bundle_units.T
        top, best = bs.max(1), _highest(bs, cfg.bundles)
        like = np.where(best >= 0, np.take_along_axis(bs, np.maximum(best, 0), 1), -np.inf)
        good = (top >= cfg.bundle_at)[:, None] & (best >= 0) & (like >= np.maximum(cfg.bundle_at, top - cfg.bundle_margin)[:, None])
        good[:, 0] = top >= cfg.bundle_at
        rows, ranks = np.nonzero(good)
        parts = [(rows, best[rows, ranks], like[rows, ranks], ranks + 1)]
        lone = np.flatnonzero(good.sum(1) == 1)
        near = self.near[best[lone, 0]]
        value = np.where(near >= 0, np.round(self.near_weight[best[lone, 0]] + 0.35 * np.take_along_axis(bs[lone], np.maximum(near, 0), 1), 9), -np.inf)
        if value.size:
            at = value.argmax(1)
            some = np.flatnonzero(value[np.arange(len(lone)), at] > -np.inf)
            other = near[some, at[some]]
            parts.append((lone[some], other, bs[lone[some], other], np.full(len(some), 2)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def categories_of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, category (as places), bundle's number, likeness to both, and whether a bundle led there: four categories of each query.

        An equal share of each bundle and then the nearest of the rest; a
        category counts for every bundle it was ever in.  Queries without a
        bundle take the nearest categories of the topic.
        """
        cfg, most = self.cfg, 2 * self.cfg.categories
        rows, bundle, bs, rank = self.bundles_of(q)
        looks = np.bincount(rows, minlength=len(q))
        # the nearest categories of each bundle taken; twice as many as can be chosen, since others may be chosen before
        lists, sims = np.full((len(rows), most), -1), np.zeros((len(rows), most))
        order = np.argsort(bundle, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1) if len(order) else []:
            held = np.array(self.held[bundle[at[0]]], np.int64)
            if len(held):
                cs = q[rows[at]] @ self.category_units[held].T
                best = _highest(cs, most)
                lists[at], sims[at] = np.where(best >= 0, held[best], -1), np.where(best >= 0, np.take_along_axis(cs, np.maximum(best, 0), 1), 0.0)
        got: list[tuple[int, int, int, float, float]] = []
        one = np.flatnonzero(looks[rows] == 1)
        x, y = np.nonzero(lists[one, : cfg.categories] >= 0)
        x = one[x]
        parts = [(rows[x], lists[x, y], self.bundles[bundle[x]], bs[x], sims[x, y])]
        pairs: dict[int, list[int]] = {}
        for i in np.flatnonzero(looks[rows] > 1):
            pairs.setdefault(int(rows[i]), []).append(int(i))
        for r, of in pairs.items():
            share = (cfg.categories + len(of) - 1) // len(of)
            seen: set[int] = set()
            rest: dict[int, tuple[int, float]] = {}
            for i in sorted(of, key=lambda i: rank[i]):
                mine = [(int(c), float(s)) for c, s in zip(lists[i], sims[i], strict=True) if c >= 0]
                fresh = [x for x in mine if x[0] not in seen][: share if rank[i] <= 2 else 0]
                got += [(r, c, int(self.bundles[bundle[i]]), float(bs[i]), s) for c, s in fresh]
                seen |= {c for c, _ in fresh}
                for c, s in mine:
                    rest.setdefault(c, (i, s))
            left = sorted((-round(s, 9), c, i, s) for c, (i, s) in rest.items() if c not in seen)
            got += [(r, c, int(self.bundles[bundle[i]]), float(bs[i]), s) for _, c, i, s in left[: cfg.categories - len(seen)]]
        if got:
            parts.append(tuple(np.array(x) for x in zip(*got, strict=True)))
        parts = [(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.ones(sum(len(x[0]) for x in parts), np.bool_)), self.nearest_of(q, np.flatnonzero(looks == 0))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def lost(self, q: np.ndarray) -> np.ndarray:
        """The queries without a bundle, which is all that ``bundles_of`` tells of them."""
        return np.flatnonzero((q @ self.bundle_units.T).max(1) < self.cfg.bundle_at) if len(self.bundles) else np.arange(len(q))

    def nearest_of(self, q: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``categories_of`` tells of the queries without a bundle: the nearest categories of the topic."""
        cs = q[lost] @ self.category_units.T
        best = _highest(cs, self.cfg.categories)
        x, y = np.nonzero(best >= 0)
        c = best[x, y]
        return lost[x], c, self.home[c], np.zeros(len(x)), cs[x, c], np.zeros(len(x), np.bool_)

    def candidates_of(self, q: np.ndarray, lost_only: bool = False) -> tuple[np.ndarray, ...]:
        """Query (its place), memory, likeness, score, bundle and whether a bundle led there, of the exemplars of each query's categories."""
        row, cat, bundle, bs, cs, by_bundle = self.nearest_of(q, self.lost(q)) if lost_only else self.categories_of(q)
        n = self.end[cat] - self.first[cat]
        e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[cat], n)
        row, bundle, bs, cs, by_bundle = (np.repeat(x, n) for x in (row, bundle, bs, cs, by_bundle))
        sim = np.einsum("ij,ij->i", q[row], self.exemplar_units[e])
        like, cs, bs = np.maximum(0.0, np.maximum(self.stored[e], sim)), np.maximum(0.0, cs), np.maximum(0.0, bs)
        return row, self.exemplars[e], sim, np.where(by_bundle, 0.55 * cs + 0.25 * bs + 0.20 * like, 0.76 * cs + 0.24 * like), bundle, by_bundle


#: Queries that are held against a map at once, and those of a block that get one copy of it: a map is as large as some 10,000 queries.
AT_ONCE, MAP_BLOCK = 256, 4 * BLOCK


def topic_blocks(queries: DataFrame, rows: DataFrame, pairs: DataFrame | None = None, block: int = BLOCK) -> PandasCogroupedOps:
    """Queries (qid, anchor, ...) dealt in blocks of a topic, of ``block`` queries, each beside the topic's ``rows``; ``pairs`` are the queries' anchors where those are told by less work."""
    queries = queries.where("anchor is not null").withColumn("qid", F.col("qid").cast("long"))
    sizes = F.broadcast((queries if pairs is None else pairs).where("anchor is not null").groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    asks = queries.join(sizes, "anchor").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")
    rows = rows.join(sizes, "anchor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asks, rows = (x.repartition(dealt(queries.sparkSession), "anchor", "block") for x in (asks, rows))
    return asks.groupBy("anchor", "block").cogroup(rows.groupBy("anchor", "block"))


def _by_topic(queries: DataFrame, mem: DataFrame, assigned: DataFrame, links: DataFrame, cfg: Art, solve: Callable[[TopicMap, np.ndarray], tuple], schema: str) -> DataFrame:
    """qid, anchor and what ``solve`` finds for each query (qid, anchor, qv) in the map of its topic, as columns of which the first is the query's place.

    Queries meet centroids in matrix products and not in rows.
    """
    arrow = to_arrow_schema(_parse_datatype_string("qid long, anchor string, " + schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            m, qid, anchor = TopicMap(right, cfg), np.asarray(left["qid"]), left["anchor"][0].as_py()
            q = unit_rows(left["qv"], m.dim)
            for lo in range(0, len(q), AT_ONCE):
                row, *found = solve(m, q[lo : lo + AT_ONCE])
                cols = [qid[lo + row], pa.repeat(anchor, len(row)), *found]
                out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    return topic_blocks(queries.select("qid", "anchor", "qv"), map_rows(mem, assigned, links, cfg), block=MAP_BLOCK).applyInArrow(run, "qid long, anchor string, " + schema)


def chosen_bundles(queries: DataFrame, mem: DataFrame, assigned: DataFrame, links: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    """qid, anchor, bundle, bs, r: the bundles that each query (qid, anchor, qv) looks into, the best first.

    Those within the margin of the best, if that fits at all; where it is
    alone, the best of its two strongest neighbours besides.
    """

    def solve(m: TopicMap, q: np.ndarray) -> tuple:
        row, bundle, bs, rank = m.bundles_of(q)
        return row, m.bundles[bundle], bs, rank

    return _by_topic(queries, mem, assigned, links, cfg, solve, "bundle long, bs double, r int")


def candidates(queries: DataFrame, mem: DataFrame, assigned: DataFrame, links: DataFrame, cfg: Art = DEFAULT.art, lost_only: bool = False) -> DataFrame:
    """qid, anchor, mem_id, sim, score, bundle, route of the memories that each query (qid, anchor, qv) should look at: the exemplars of its categories.

    A memory is in one category, so no pair comes twice.  ``lost_only``: the
    same rows of the queries without a bundle, and none of the others.
    """

    def solve(m: TopicMap, q: np.ndarray) -> tuple:
        *found, by_bundle = m.candidates_of(q, lost_only)
        return *found, np.where(by_bundle, "bundle", "category")

    return _by_topic(queries, mem, assigned, links, cfg, solve, "mem_id long, sim double, score double, bundle long, route string")


def _cent_sql(level: str) -> str:
    return f"SELECT anchor, {level}, {_unit_sql('v')} AS centroid FROM (SELECT anchor, {level}, list(x ORDER BY p) AS v FROM (SELECT a.anchor, a.{level}, p, avg(m.vec[p]) AS x FROM art a JOIN {{mem}} m USING (mem_id), range(1, 65) r(p) GROUP BY ALL) GROUP BY ALL)"


def candidates_sql(mem: str, queries: str) -> str:
    """``candidates`` as ``ca``, for ``queries`` of qid, anchor, qv; ``tk`` has the bundles."""
    return f"""bcen AS MATERIALIZED ({_cent_sql('bundle').format(mem=mem)}), ccen AS MATERIALIZED ({_cent_sql('category').format(mem=mem)}), held AS (SELECT DISTINCT anchor, bundle, category FROM art), home AS (SELECT anchor, category, arg_max(bundle, turn) AS home FROM art GROUP BY ALL), {_LINKS},
qt AS MATERIALIZED ({queries}), qb AS (SELECT qid, anchor, b.bundle, {_COS}(qv, b.centroid) AS bs FROM qt JOIN bcen b USING (anchor)),
qr AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor ORDER BY round(bs, 9) DESC, bundle) AS r, max(bs) OVER (PARTITION BY qid, anchor) AS top FROM qb),
sel AS (SELECT qid, anchor, bundle, bs, r FROM qr WHERE top >= 0.82 AND r <= 2 AND (r = 1 OR bs >= greatest(0.82, top - 0.06))), lone AS (SELECT qid, anchor, bundle FROM sel QUALIFY count(*) OVER (PARTITION BY qid, anchor) = 1),
nb AS (SELECT l.qid, l.anchor, lk.other AS bundle, lk.weight FROM lone l JOIN lk USING (anchor, bundle) QUALIFY row_number() OVER (PARTITION BY qid, anchor ORDER BY weight DESC, other) <= 2),
nr AS (SELECT nb.qid, nb.anchor, nb.bundle, qb.bs FROM nb JOIN qb USING (qid, anchor, bundle) QUALIFY row_number() OVER (PARTITION BY nb.qid, nb.anchor ORDER BY round(weight + 0.35 * bs, 9) DESC, nb.bundle) = 1),
tk AS MATERIALIZED (SELECT qid, anchor, bundle, bs, r FROM sel UNION ALL SELECT qid, anchor, bundle, bs, 2 FROM nr), tn AS (SELECT *, count(*) OVER (PARTITION BY qid, anchor) AS nsel FROM tk),
tc AS (SELECT t.*, h.category, {_COS}(q.qv, c.centroid) AS cs FROM tn t JOIN qt q USING (qid, anchor) JOIN held h USING (anchor, bundle) JOIN ccen c USING (anchor, category)),
kc AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor, r ORDER BY round(cs, 9) DESC, category) AS k1 FROM tc), first1 AS (SELECT * FROM kc WHERE r = 1 AND k1 <= (4 + nsel - 1) // nsel),
kd AS (SELECT kc.* FROM kc ANTI JOIN first1 f ON f.qid = kc.qid AND f.anchor = kc.anchor AND f.category = kc.category WHERE kc.r = 2), first2 AS (SELECT * FROM kd QUALIFY row_number() OVER (PARTITION BY qid, anchor ORDER BY round(cs, 9) DESC, category) <= (4 + nsel - 1) // nsel),
got1 AS (SELECT qid, anchor, bundle, category, bs, cs FROM first1 UNION ALL SELECT qid, anchor, bundle, category, bs, cs FROM first2),
spill0 AS (SELECT kc.* FROM kc ANTI JOIN got1 g ON g.qid = kc.qid AND g.anchor = kc.anchor AND g.category = kc.category QUALIFY row_number() OVER (PARTITION BY kc.qid, kc.anchor, kc.category ORDER BY kc.r) = 1),
spill AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor ORDER BY round(cs, 9) DESC, category) AS k FROM spill0), have AS (SELECT qid, anchor, count(*) AS n FROM got1 GROUP BY ALL),
got AS (SELECT *, 'bundle' AS route FROM got1 UNION ALL SELECT s.qid, s.anchor, s.bundle, s.category, s.bs, s.cs, 'bundle' FROM spill s JOIN have h USING (qid, anchor) WHERE s.k <= 4 - h.n
  UNION ALL SELECT q.qid, q.anchor, h.home, c.category, 0.0, {_COS}(q.qv, c.centroid), 'category' FROM qt q JOIN ccen c USING (anchor) JOIN home h USING (anchor, category) ANTI JOIN sel s ON s.qid = q.qid AND s.anchor = q.anchor QUALIFY row_number() OVER (PARTITION BY q.qid, q.anchor ORDER BY round({_COS}(q.qv, c.centroid), 9) DESC, c.category) <= 4),
exm AS (SELECT anchor, category, mem_id, score AS stored FROM art QUALIFY row_number() OVER (PARTITION BY anchor, category ORDER BY round(score, 9) DESC, mem_id) <= 12),
cs0 AS (SELECT g.*, e.mem_id, e.stored, {_COS}(q.qv, m.vec) AS sim FROM got g JOIN exm e USING (anchor, category) JOIN qt q USING (qid, anchor) JOIN {mem} m ON m.mem_id = e.mem_id),
ca AS MATERIALIZED (SELECT qid, anchor, mem_id, sim, CASE WHEN route = 'bundle' THEN 0.55 * greatest(0, cs) + 0.25 * greatest(0, bs) + 0.2 * greatest(0, greatest(stored, sim)) ELSE 0.76 * greatest(0, cs) + 0.24 * greatest(0, greatest(stored, sim)) END AS score, bundle, route FROM cs0)"""


def _route(spark: SparkSession, sf_dir: str, elsewhere: bool = False) -> DataFrame:
    mem, a = _art(spark, sf_dir)
    q = mem.select(F.col("mem_id").alias("qid"), "anchor", F.col("vec").alias("qv"))
    if elsewhere:
        other = mem.select("scope_key", F.col("anchor").alias("other")).distinct()
        q = mem.select("scope_key", F.col("mem_id").alias("qid"), "anchor", F.col("vec").alias("qv")).join(other, "scope_key").where("anchor <> other").select("qid", F.col("other").alias("anchor"), "qv")
    c = candidates(q, mem, a, bundle_links(a), lost_only=elsewhere)
    return c.select("qid", "anchor", "mem_id", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"), "bundle", "route")


_OWN = "SELECT mem_id AS qid, anchor, vec AS qv FROM mem"
_OTHERS = "SELECT q.mem_id AS qid, o.anchor, q.vec AS qv FROM mem q JOIN (SELECT DISTINCT scope_key, anchor FROM mem) o ON o.scope_key = q.scope_key AND o.anchor <> q.anchor"
_CA = "SELECT qid, anchor, mem_id, round(sim, 6) AS sim, round(score, 6) AS score, bundle, route FROM ca"


@query("a4_bundle_route", f"{_ART}, {candidates_sql('mem', _OWN)} {_CA} WHERE route = 'bundle'")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asks its own topic."""
    return _route(spark, sf_dir).where("route = 'bundle'")


@query("a5_category_route", f"{_ART}, {candidates_sql('mem', _OTHERS)} {_CA} WHERE route = 'category'")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asks the other topics of its scope, none of whose bundles fits."""
    return _route(spark, sf_dir, elsewhere=True).where("route = 'category'")


class Prior:
    def __init__(self, key: str):
        self.key, self.value, self.last = key, 0.0, None


def reinforce_step(cfg: Art):
    """p <- clamp(p + lr (1 - p), 0, cap) after decay by the turns that passed."""

    def step(s: Prior, row: dict) -> list[tuple]:
        if s.last is not None:
            s.value *= cfg.decay ** (row["turn"] - s.last)
        s.value = min(cfg.prior_cap, max(0.0, s.value + row["lr"] * (1 - s.value)))
        s.last = row["turn"]
        return [(s.key, row["turn"], s.value)]

    return step


@query("a6_reinforce", f"""WITH {TURNS}, {MEMORIES}, x AS (SELECT anchor, turn, CASE WHEN turn % 3 = 0 THEN 0.18 ELSE 0.1 END::DOUBLE AS lr, row_number() OVER (PARTITION BY anchor ORDER BY turn) AS n FROM mem),
r AS (WITH RECURSIVE f AS (SELECT anchor, turn, n, lr AS value FROM x WHERE n = 1 UNION ALL SELECT x.anchor, x.turn, x.n, least(4.0, greatest(0.0, f.value * pow(0.996, x.turn - f.turn) + x.lr * (1 - f.value * pow(0.996, x.turn - f.turn))))::DOUBLE FROM f JOIN x ON x.anchor = f.anchor AND x.n = f.n + 1) SELECT * FROM f) SELECT anchor AS \"key\", turn, round(value, 6) AS value FROM r""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = memories(turns(spark, sf_dir)).select(F.col("anchor").alias("key"), "turn", F.when(F.col("turn") % 3 == 0, 0.18).otherwise(0.10).alias("lr"))
    return keyed_fold(ev, "key", ["turn"], Prior, reinforce_step(DEFAULT.art), "key string, turn long, value double").withColumn("value", F.round("value", 6))


@query("a7_state", f"{_ART} SELECT anchor, mem_id, category, bundle FROM art")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a topic's map as a table: every memory's category and bundle."""
    return _art(spark, sf_dir)[1].select("anchor", "mem_id", "category", "bundle")


def bundle_feedback(signals: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    """key, turn, lr: what a recall teaches the bundles it looked into (qid, anchor, bundle, r, n), n being the rank of their topic among the chosen.

    Each of them was recalled; if the topic was chosen first, they are adopted
    too, all but the first by a share of it.
    """
    recall = signals.where("n is not null").select(F.concat_ws("#", "anchor", F.col("bundle").cast("string"), F.lit("recall")).alias("key"), F.col("qid").alias("turn"), F.lit(cfg.recall_lr).alias("lr"))
    adopt = F.when(F.col("r") == 1, cfg.adopt_lr).otherwise(cfg.adopt_lr * 0.35)
    return recall.unionByName(signals.where("n = 1").select(F.concat_ws("#", "anchor", F.col("bundle").cast("string"), F.lit("adopt")).alias("key"), F.col("qid").alias("turn"), adopt.alias("lr")))


def learned(events: DataFrame, cfg: Art = DEFAULT.art) -> DataFrame:
    """key, prior, touches after all events (key, turn, lr)."""
    v = keyed_fold(events, "key", ["turn"], Prior, reinforce_step(cfg), "key string, turn long, value double")
    return v.groupBy("key").agg(F.max_by("value", "turn").alias("prior"), F.count("*").alias("touches"))
