"""Vector kernels and vector scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.fixtures import cosine, dot, mean_of, norm, read, unit

#: Below so many query vectors the query side is broadcast.
BROADCAST_QUERIES = 10_000

_E = "e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_C = "cp AS (SELECT label, p, avg(v[p]) AS x FROM e, range(1, 65) r(p) GROUP BY ALL), c AS MATERIALIZED (SELECT label, list(x ORDER BY p) AS m FROM cp GROUP BY label)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


#: Components of the vectors at hand.
DIM = 64


def mean_vectors(df: DataFrame, key: str, vec: str = "v", normalised: bool = False, dim: int = DIM) -> DataFrame:
    """key, m: the element-wise mean of each group; one sum for each component, so tasks add up what they have before anything is sent."""
    m = mean_of(vec, dim)
    return df.where(F.size(vec) > 0).groupBy(key).agg((unit(m) if normalised else m).alias("m"))


def blend_ema(a: Column, b: Column, beta: float) -> Column:
    """normalize((1 - beta) a + beta b), beta held in [.01, 1]."""
    beta = min(1.0, max(0.01, beta))
    return unit(F.zip_with(a, b, lambda x, y: x * (1 - beta) + y * beta))


def small(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Marks a side for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of one block of queries and of one chunk of data, which bound what a task holds.
BLOCK, CHUNK = 4096, 65_536


def matrix(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as rows."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.asarray(c.flatten(), np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def similarities(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The scores that an index with this metric reports: -d, 1 - d, or ln((1 - d) / d) with d = 1 / (1 + e^dot), which is the dot product."""
    if metric == "l2":
        return -np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)))
    if metric == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return np.divide(q @ v.T, n, out=np.zeros((len(q), len(v))), where=n > 0)
    return q @ v.T


def _local_best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, metric: str, threshold: float | None) -> pa.RecordBatch:
    """The best k of some data for each of some queries, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q) if len(ids) else 0, 256):
        sims = np.round(similarities(metric, q[lo : lo + 256], v), 12)
        least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(sims), -np.inf)
        least = least if threshold is None else np.maximum(least, threshold)
        for i, row in enumerate(sims):
            at = np.flatnonzero(row >= least[i])
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            parts.append((np.full(len(at), qid[lo + i]), ids[at], row[at]))
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "id", "sim"])


_BEST = "qid long, id long, sim double"


def knn_topk(queries: DataFrame, data: DataFrame, k: int = 8, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """qid, rank, id, sim: each query's k most similar rows, ties by id.

    Few queries, by a count, are held by every task that reads data.  More are
    dealt in blocks to chunks of data, each pair of which is one task's matrix
    product.  Either way k rows a query leave a task.
    """
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qv").alias("v"))
    data = data.select(F.col("id").cast("long").alias("id"), "v")
    few = queries.limit(BROADCAST_QUERIES + 1).count()
    if few <= BROADCAST_QUERIES:
        got = queries.toArrow()
        held = queries.sparkSession.sparkContext.broadcast((np.asarray(got["qid"]), matrix(got["v"])))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and few:
                    yield _local_best(*held.value, np.asarray(b.column(0)), matrix(b.column(1)), k, metric, threshold)

        local = data.mapInArrow(scan, _BEST)
    else:
        sizes = [max(1, -(-df.count() // n)) for df, n in ((queries, BLOCK), (data, CHUNK))]
        own = [F.pmod(F.xxhash64(c), F.lit(n)) for c, n in zip(("qid", "id"), sizes, strict=True)]
        every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in sizes]
        q = queries.select(own[0].cast("int").alias("block"), every[1].alias("chunk"), F.lit(True).alias("asks"), F.col("qid").alias("id"), "v")
        d = data.select(every[0].alias("block"), own[1].cast("int").alias("chunk"), F.lit(False).alias("asks"), "id", "v")

        def solve(t: pa.Table) -> pa.Table:
            asks, ids, v = np.asarray(t["asks"]), np.asarray(t["id"]), matrix(t["v"])
            return pa.Table.from_batches([_local_best(ids[asks], v[asks], ids[~asks], v[~asks], k, metric, threshold)])

        local = q.unionByName(d).groupBy("block", "chunk").applyInArrow(solve, _BEST)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("sim", 9).desc(), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id 100 divides ask all rows."""
    v = vectors(spark, sf_dir)
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), v.select(F.col("vec_id").alias("id"), "v")


class VectorIndex:
    """An approximate index: rows in the cells of centroids, of which a search looks into the nearest.

    Centroids come from a few rounds of k-means over ``SAMPLE`` rows at most;
    every row is indexed.  ``probes`` is set by measuring recall against the
    exact scan, so a search reaches the recall asked for on the sample's queries.
    """

    SAMPLE, ROUNDS = 20_000, 5

    def __init__(self, metric: str, centroids: np.ndarray, rows: DataFrame, probes: int):
        self.metric, self.centroids, self.rows, self.probes = metric, centroids, rows, probes

    @classmethod
    def create(cls, data: DataFrame, metric: str = "cosine", cells: int | None = None, target: float = 0.95, k: int = 48) -> VectorIndex:
        """An index over rows (id, v)."""
        got = data.orderBy(F.xxhash64("id"), "id").limit(cls.SAMPLE).toArrow()
        v = matrix(got["v"])
        n = max(1, min(len(v), cells or int(max(1, data.count()) ** 0.5)))
        c = v[np.linspace(0, len(v) - 1, n).astype(np.int64)] if len(v) else v
        for _ in range(cls.ROUNDS if len(v) else 0):
            at = similarities("l2", v, c).argmax(1)
            c = np.stack([v[at == i].mean(0) if (at == i).any() else c[i] for i in range(n)])
        index = cls(metric, c, data.limit(0).select(F.lit(0).alias("cell"), "id", "v"), n)
        index.rows = index._placed(data)
        if len(v):
            index.probes = index._tuned(np.asarray(got["id"]), v, target, k)
        return index

    def _placed(self, data: DataFrame) -> DataFrame:
        held = data.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = similarities("l2", matrix(b.column(1)), held.value).argmax(1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1)], names=["cell", "id", "v"])

        return data.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "cell int, id long, v array<double>")

    def _tuned(self, ids: np.ndarray, v: np.ndarray, target: float, k: int) -> int:
        """The fewest cells that hold the target share of the sample's own nearest neighbours."""
        ask = np.flatnonzero(ids % 100 == 0)[:200]
        ask = ask if len(ask) else np.arange(min(len(v), 20))
        best = np.argsort(-similarities(self.metric, v[ask], v), axis=1, kind="stable")[:, :k]
        cell = similarities("l2", v, self.centroids).argmax(1)
        order = np.argsort(-similarities(self.metric, v[ask], self.centroids), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        rank = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
        return int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))))]) + 1

    def add(self, data: DataFrame) -> None:
        """More rows, into the cells there are."""
        self.rows = self.rows.unionByName(self._placed(data))

    def search(self, queries: DataFrame, k: int = 48, probes: int | None = None) -> DataFrame:
        """qid, rank, id, sim of queries (qid, qv), from their nearest cells."""
        held, n, metric = queries.sparkSession.sparkContext.broadcast(self.centroids), min(probes or self.probes, len(self.centroids)), self.metric

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cells = np.argsort(-similarities(metric, matrix(b.column(1)), held.value), axis=1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), b.column(0).take(at), b.column(1).take(at)], names=["cell", "qid", "v"])

        asks = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qv").cast("array<double>").alias("v")).mapInArrow(deal, "cell int, qid long, v array<double>")

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_local_best(np.asarray(left["qid"]), matrix(left["v"]), np.asarray(right["id"]), matrix(right["v"]), k, metric, None)])

        local = asks.groupBy("cell").cogroup(self.rows.groupBy("cell")).applyInArrow(solve, _BEST)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("sim", 9).desc(), "id"))
        return local.withColumn("rank", rank).where(F.col("rank") <= k)

    def save(self, path: str) -> None:
        """Rows by cell, and what describes them beside."""
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(self.metric, self.probes, i, c.tolist()) for i, c in enumerate(self.centroids)], "metric string, probes int, cell int, centroid array<double>").write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = sorted(spark.read.parquet(f"{path}/meta").collect(), key=lambda r: r.cell)
        return cls(meta[0].metric, np.array([r.centroid for r in meta]), spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/rows"), meta[0].probes)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of the exact result that was found."""
    j = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return j.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def _with_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.join(small(mean_vectors(v, "label")), "label")


@query("v1_dot", f"WITH {_E}, {_C} SELECT vec_id, round(list_inner_product(v, m), 6) AS dot FROM e JOIN c USING (label)")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_centroid(spark, sf_dir).select("vec_id", F.round(dot(F.col("v"), F.col("m")), 6).alias("dot"))


@query("v2_cosine", f"WITH {_E}, {_C} SELECT vec_id, round(list_cosine_similarity(v, m), 6) AS cos FROM e JOIN c USING (label)")
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_centroid(spark, sf_dir).select("vec_id", F.round(cosine(F.col("v"), F.col("m")), 6).alias("cos"))


@query("v3_normalize", f"WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: 3 * x) AS v FROM e) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM s")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x * 3).alias("v"))
    return v.select("vec_id", F.round(norm(F.col("v")), 6).alias("norm"), F.round(unit(F.col("v"))[0], 6).alias("first"))


@query("v4_mean_vector", f"WITH {_E}, {_C} SELECT label, p, round(m[p], 6) AS x FROM c, range(1, 65) r(p)")
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_vectors(vectors(spark, sf_dir), "label")
    return m.select("label", F.posexplode("m").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query("v5_mean_unit", f"WITH {_E}, {_C} SELECT label, p, round(m[p] / sqrt(list_inner_product(m, m)), 6) AS x FROM c, range(1, 65) r(p)")
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_vectors(vectors(spark, sf_dir), "label", normalised=True)
    return m.select("label", F.posexplode("m").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query("v6_ema_blend", f"WITH {_E}, {_C}, b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.72 * m[i] + 0.28 * v[i]) AS w FROM e JOIN c USING (label)) SELECT vec_id, round(w[1] / sqrt(list_inner_product(w, w)), 6) AS first, round(w[64] / sqrt(list_inner_product(w, w)), 6) AS last FROM b")
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _with_centroid(spark, sf_dir).select("vec_id", blend_ema(F.col("m"), F.col("v"), 0.28).alias("w"))
    return b.select("vec_id", F.round(F.col("w")[0], 6).alias("first"), F.round(F.element_at("w", -1), 6).alias("last"))


def _knn_sql(score: str, k: int) -> str:
    return f"WITH {_E}, s AS (SELECT q.vec_id AS qid, d.vec_id AS id, {score} AS sim FROM e q JOIN e d ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM s) SELECT qid, rank::INT AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= {k}"


_IP = "list_inner_product(q.v, d.v)"
_SCORES = {"cosine": "list_cosine_similarity(q.v, d.v)", "l2": "-list_distance(q.v, d.v)", "ip": f"ln((1 - 1 / (1 + exp({_IP}))) / (1 / (1 + exp({_IP}))))"}


def _knn_query(metric: str, k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, data = _asked(spark, sf_dir)
        return knn_topk(q, data, k, metric).select("qid", F.col("rank").cast("int").alias("rank"), "id", F.round("sim", 6).alias("sim"))

    return run


query("v7_knn_topk", _knn_sql(_SCORES["cosine"], 8))(_knn_query("cosine", 8))
query("v9_cosine_topk", _knn_sql(_SCORES["cosine"], 48))(_knn_query("cosine", 48))
query("v9_l2_topk", _knn_sql(_SCORES["l2"], 48))(_knn_query("l2", 48))
query("v9_ip_topk", _knn_sql(_SCORES["ip"], 48))(_knn_query("ip", 48))


@query("v9_index_recall", "SELECT * FROM (VALUES ('cosine', true, true), ('l2', true, true), ('ip', true, true)) v(metric, enough, all_indexed)")
def v9_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index of each metric, built from one half of the rows and given the other, finds nine tenths of the exact result."""
    q, data = _asked(spark, sf_dir)
    out = None
    for metric in ("cosine", "l2", "ip"):
        index = VectorIndex.create(data.where("id % 2 = 0"), metric)
        index.add(data.where("id % 2 = 1"))
        n = index.rows.agg(F.count("*").alias("n")).join(data.agg(F.count("*").alias("all")), F.lit(True)).select((F.col("n") == F.col("all")).alias("all_indexed"))
        r = recall_of(index.search(q, 48), knn_topk(q, data, 48, metric)).select(F.lit(metric).alias("metric"), (F.col("recall") >= 0.9).alias("enough")).join(n, F.lit(True))
        out = r if out is None else out.unionByName(r)
    return out


@query("v8_full_scan", f"WITH {_E}, {_C} SELECT vec_id, round(list_cosine_similarity(v, (SELECT m FROM c WHERE label = 0)), 6) AS sim FROM e")
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = mean_vectors(v.where("label = 0"), "label").select(F.col("m"))
    return v.join(small(q), F.lit(True)).select("vec_id", F.round(cosine(F.col("v"), F.col("m")), 6).alias("sim")).orderBy(F.col("sim").desc(), "vec_id")


@query("v10_topic_index", f"WITH {_E}, {_C}, p AS (SELECT a.label AS label, b.label AS other, list_cosine_similarity(a.m, b.m) AS sim FROM c a, c b WHERE a.label <> b.label), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, other) AS rank FROM p) SELECT label, other, round(sim, 6) AS sim FROM r WHERE rank <= 2")
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest topics of each topic, by an index over their centroids that looks into every cell."""
    c = mean_vectors(vectors(spark, sf_dir), "label")
    index = VectorIndex.create(c.select(F.col("label").cast("long").alias("id"), F.col("m").alias("v")))
    found = index.search(c.select(F.col("label").alias("qid"), F.col("m").alias("qv")), 3, probes=len(index.centroids)).where("qid <> id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return found.withColumn("n", rank).where("n <= 2").select(F.col("qid").cast("int").alias("label"), F.col("id").cast("int").alias("other"), F.round("sim", 6).alias("sim"))


def to_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.format_string("%.10f", x)), ",")


def from_text(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda x: F.coalesce(F.expr("1D") * x.try_cast("double"), F.lit(0.0)))


@query("v11_text_codec", f"WITH {_E} SELECT vec_id, len(v)::INT AS parts, round(list_sum(list_transform(v, lambda x: round(x, 10))), 6) AS total FROM e")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", to_text(F.col("v")).alias("spelt"))
    return v.select("vec_id", F.size(F.split("spelt", ",")).alias("parts"), F.round(F.aggregate(from_text(F.col("spelt")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("v12_binary_codec", f"WITH {_E} SELECT vec_id, len(v)::INT AS n, round(list_sum(v), 4) AS total FROM e")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through their length-prefixed little-endian form and back."""
    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.array([len(x)], "<u4").tobytes() + np.asarray(x, "<f4").tobytes())

    @F.pandas_udf("array<double>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4", int(np.frombuffer(x, "<u4", 1)[0]), 4).astype("f8"))

    v = vectors(spark, sf_dir).select("vec_id", decode(encode("v")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


#: Texts of one call to an embedder.
EMBED_BATCH = 64
#: How a text is marked as a question or as something to be found.
MODES = {"query": "query: ", "passage": "passage: "}
Embedder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, embedder: Embedder, mode: str = "passage", batch: int = EMBED_BATCH) -> DataFrame:
    """The rows with ``vec``: what the embedder, a function that executors can run, makes of valid texts, batch by batch."""
    prefix, at = MODES[mode], df.columns.index(text)
    schema = df.withColumn("vec", F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [prefix + (t or "") for t in b.column(at).to_pylist()]
            rows = [r for lo in range(0, len(said), batch) for r in np.asarray(embedder(said[lo : lo + batch]), np.float64).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "vec"])

    return df.withColumn(text, F.expr(f"make_valid_utf8({text})")).mapInArrow(run, schema)


def hashed_words(texts: list[str], dim: int = 8) -> np.ndarray:
    """A plain embedder: counts of words by hash."""
    import hashlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.split(" "):
            out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim] += 1
    return out


@query("v13_embedding_input", "WITH m AS (SELECT conv_id, turn, text, unnest(['query', 'passage']) AS mode FROM conversations), w AS (SELECT conv_id, turn, mode, text, unnest(string_split(mode || ': ' || text, ' ')) AS w FROM m) SELECT conv_id, turn, mode, any_value(length(text)) AS n_chars, any_value(strlen(text)) AS n_bytes, sum((('0x' || substr(md5(w), 1, 4))::INT % 8 = 0)::INT)::DOUBLE AS first, sum((('0x' || substr(md5(w), 1, 4))::INT % 8 = 7)::INT)::DOUBLE AS last FROM w GROUP BY conv_id, turn, mode")
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedder is given, as a question and as a passage, and gives back."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    both = None
    for mode in MODES:
        e = embed(c, "text", hashed_words, mode).withColumn("mode", F.lit(mode))
        both = e if both is None else both.unionByName(e)
    return both.select("conv_id", "turn", "mode", F.char_length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("vec")[0].alias("first"), F.element_at("vec", -1).alias("last"))
