"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything is a DataFrame expression.  The words of a source are laid out in a
seeded hash order of its documents.  A source takes as many whole passes over
that order as its target holds and then a prefix of it; the prefix ends inside
one document, found by descending a 64-way radix tree of bucket sums, so no
source is ever sorted or gathered as a whole.

A pass is cut into blocks by hash range.  The block quota of every source is
split among output shards by a binary tree: at a node the number of each
source's blocks that go left is drawn, by inversion, from its hypergeometric
law given the draws before it, so all together follow the multivariate law with
an exact total.  A node holds only sources that still have blocks there, and
nodes are spread over tasks again after every few levels.  Blocks are then dealt
to shards in a permuted order, each instance to one shard, and rows are shuffled
inside the shard.

Defined results: a null or blank text has size 0 and is never taken; null is a
source of its own, last in order; repeated rows are separate rows; sources
whose weight would ask more than ``cap`` passes stop there and the rest is
shared again; an empty table gives an empty result; other columns travel as one
struct, so that none of their names can meet one of ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 30
#: Above so many blocks their shards are joined by a shuffle instead of a broadcast, so that texts are shuffled once only below.
BROADCAST_BLOCKS = 200_000
#: Above so many sources the table of sources is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def _skey(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _unit(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _other(docs: DataFrame) -> list[Column]:
    """The columns of documents that mixing doesn't read, as one; none if there are none."""
    names = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    return [F.struct(*[F.col(f"`{c}`") for c in names]).alias("other")] if names else []


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """One row per document with its size and its place in the seeded order; text as it is, further columns in ``other``."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.col("text").cast("string").alias("text"), *_other(docs))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), 64 - _BITS)
    # tells rows of one id apart alike in every run, whatever the partitions
    mark = F.xxhash64("text", *([F.col("other").cast("string")] if "other" in rows.columns else []))
    return rows.select("*", _skey(F.col("source")).alias("skey"), u.alias("u"), F.shiftright(u, 12).alias("leaf"), mark.alias("mark"), F.monotonically_increasing_id().alias("row"))


def _ranked(by: DataFrame) -> DataFrame:
    """Sources with idx, their place in the order of code points, null last: ranks inside ranges and the sizes of the ranges before."""
    dealt = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, "mix-sources")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(F.broadcast(parts), "part").withColumn("idx", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """skey, idx, source_size, n_docs, target: shares by weight, sources at their cap and the rest shared again until none is above.

    Sizes and weights are whole numbers, so their sums, and with them the
    targets, are the same in every run.
    """
    by = _ranked(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    by = scratch.table(by.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size")), "mix-weights")
    budget = float(share) * float(by.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.col("w") * F.lit(level)
        n, held, free = by.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - float(held or 0.0)) / free
    return by.select("skey", "source", "idx", "source_size", "n_docs", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def _plan(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Adds to each source its whole passes and the leaf in which its last, partial pass ends."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("passes", passes)
    per = per.withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("source_size"))
    leaves = rows.groupBy("skey", "leaf").agg(F.sum("size").alias("size"))
    at, rest = per.select("skey", F.col("rest").alias("left"), F.lit(0).cast("long").alias("node")), None
    for shift in (12, 6, 0):
        level = leaves.withColumn("node", F.shiftright("leaf", shift)).groupBy("skey", "node").agg(F.sum("size").alias("size"))
        # 64 children of one node for each source
        kids = level.join(at.select("skey", "left", F.col("node").alias("up")), "skey").where(F.shiftright("node", 6) == F.col("up"))
        run = F.sum("size").over(Window.partitionBy("skey").orderBy("node"))
        kids = kids.withColumn("upto", run)
        hit = F.min(F.when(F.col("upto") > F.col("left"), F.struct("node", (F.col("left") - F.col("upto") + F.col("size")).alias("left"))))
        at = kids.groupBy("skey").agg(hit.alias("hit")).select("skey", F.col("hit.node").alias("node"), F.col("hit.left").alias("left"))
    cut = at.select("skey", F.col("node").alias("cut_leaf"), F.col("left").alias("cut_left"))
    return per.join(cut, "skey", "left")


def _with_sources(rows: DataFrame, per: DataFrame) -> DataFrame:
    small = per.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(per) if small else per, "skey", "inner")


def _takes(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Each document with ``takes``: the words it gives in each pass."""
    d = _with_sources(rows, per.drop("source"))
    edge = F.col("leaf") == F.col("cut_leaf")
    inside = d.where(edge)
    order = Window.partitionBy("skey").orderBy("u", "doc_id", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("cut_left") - before)))
    outside = d.where(F.coalesce(~edge, F.lit(True))).withColumn("part", F.when(F.col("leaf") < F.col("cut_leaf"), F.col("size")).otherwise(F.lit(0).cast("long")))
    d = inside.unionByName(outside)
    whole = F.when(F.col("passes") > 0, F.array_repeat("size", F.col("passes").cast("int"))).otherwise(F.array().cast("array<long>"))
    return d.withColumn("takes", F.concat(whole, F.array("part")))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of the ``marked`` among ``total`` are in ``drawn`` of them, by inversion of u in [0, 1).

    The law is summed from eight standard deviations below the mean to as many
    above it, outside of which lies less than 1e-14, with weights relative to
    the first.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    sd = F.sqrt(F.when(n > 1, mean * (1 - k / n) * (n - d) / (n - 1)).otherwise(0.0))
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - 8 * sd).cast("double")).cast("long")
    high = F.least(k, d, F.ceil(mean + 8 * sd).cast("double")).cast("long")
    places = F.sequence(low, F.greatest(low, high))

    def after(w: Column, x: Column) -> Column:
        at = x.cast("double")
        return w * (k - at) * (d - at) / ((at + 1) * (n - k - d + at + 1))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(places, zero, lambda a, x: F.struct(after(a["w"], x).alias("w"), (a["sum"] + a["w"]).alias("sum")))["sum"]

    def step(a: Column, x: Column) -> Column:
        upto = a["sum"] + a["w"]
        return F.struct(after(a["w"], x).alias("w"), upto.alias("sum"), F.when(upto <= u * a["mass"], x + 1).otherwise(a["at"]).alias("at"), a["mass"].alias("mass"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("at"), mass.alias("mass"))
    return F.least(F.aggregate(places, start, step)["at"], F.greatest(low, high))


#: Levels of the tree between which its nodes are spread over tasks.
LEVELS = 5


def _split(node: DataFrame, seed: int) -> DataFrame:
    """Nodes (lo, hi, cells of idx, skey and n) of the next level; those of one shard stay."""
    several = F.col("hi") - F.col("lo") > 1
    blocks = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    node = node.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn("blocks", blocks)
    wanted = F.floor(F.col("blocks") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")

    def draw(a: Column, c: Column) -> Column:
        got = hypergeometric(a["rem"], c["n"], a["want"], _unit(F.lit(seed), F.col("lo"), F.col("hi"), c["idx"]))
        return F.struct((a["want"] - got).alias("want"), (a["rem"] - c["n"]).alias("rem"), F.concat(a["out"], F.array(got)).alias("out"))

    zero = F.struct(wanted.alias("want"), F.col("blocks").alias("rem"), F.array().cast("array<long>").alias("out"))
    node = node.withColumn("left", F.when(several, F.aggregate("cells", zero, draw)["out"]))
    cell = lambda c, n: F.struct(c["idx"].alias("idx"), c["skey"].alias("skey"), n.cast("long").alias("n"))
    some = lambda cells: F.filter(cells, lambda c: c["n"] > 0)
    left = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), some(F.zip_with("cells", "left", cell)).alias("cells"))
    right = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), some(F.zip_with("cells", "left", lambda c, x: cell(c, c["n"] - x))).alias("cells"))
    same = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("cells").alias("cells"))
    return node.select(F.explode(F.when(several, F.array(left, right)).otherwise(F.array(same))).alias("p")).select("p.*")


def _quotas(per: DataFrame, block_docs: int, shard_blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of each source, and the shard of each block instance."""
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long")
    per = per.withColumn("n_blocks", n_blocks)
    last = F.shiftrightunsigned((F.shiftleft(F.col("cut_leaf") + 1, 12) - 1) * F.col("n_blocks"), _BITS)
    quota = F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, last + 1).otherwise(0)
    per = per.withColumn("quota", F.when(F.col("target") >= 1, quota).otherwise(0).cast("long"))
    total = per.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    # the root has one cell for each source
    listed = F.array_sort(F.collect_list(F.struct("idx", "skey", F.col("quota").alias("n"))))
    node = per.where("quota > 0").agg(listed.alias("cells")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "cells")
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        if level and level % LEVELS == 0:
            node = scratch.table(node.repartition("lo"), "mix-tree")
        node = _split(node, seed)
    cells = node.select(F.col("lo").alias("shard"), F.explode("cells").alias("c")).select("shard", "c.skey", "c.n")
    end = F.sum("n").over(Window.partitionBy("skey").orderBy("shard"))
    cells = cells.withColumn("end", end)
    cells = cells.join(per.select("skey", "quota"), "skey")
    deal = cells.select("skey", "quota", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("slot"))
    # a prime above every quota is coprime to each, so this is a permutation of the instances
    inst = (F.col("slot") * F.lit(2147483647).cast("long") + F.pmod(F.xxhash64(F.lit(seed), "skey"), F.col("quota"))) % F.col("quota")
    deal = deal.select("skey", inst.alias("inst"), "shard")
    return per, F.broadcast(deal) if total <= BROADCAST_BLOCKS else deal


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_docs: int = 64, shard_blocks: int = 64, seed: int = 20260105
) -> DataFrame:
    """One row for each draw of a document, and one with no shard for a document that isn't drawn.

    row, doc_id, source, size, source_size, target, pass, words, shard, place,
    text, and other with the further columns if there are any.  ``words`` counts
    from the document's first word, and ``text`` is cut behind the last of them;
    it is null where nothing is drawn.  ``in_shards`` gathers the rows of a shard
    in the order of ``place``.
    """
    rows = scratch.table(sized(docs, seed), "mix-sized", "zstd")
    carried = [c for c in ("text", "other") if c in rows.columns]
    per = scratch.table(_plan(rows, targets(rows, weights, share, cap)), "mix-plan")
    per, deal = _quotas(per, block_docs, shard_blocks, seed)
    d = _takes(rows, per)
    block = F.shiftrightunsigned(F.col("u") * F.col("n_blocks"), _BITS)
    draws = F.filter(F.transform("takes", lambda w, i: F.struct(i.alias("pass"), w.alias("words"))), lambda x: x["words"] > 0)
    d = d.select("row", "mark", "doc_id", "source", "skey", "size", "source_size", "target", "n_blocks", *carried, block.alias("block"), F.explode_outer(draws).alias("x"))
    d = d.withColumn("inst", F.col("x.pass") * F.col("n_blocks") + F.col("block"))
    d = d.join(deal, ["skey", "inst"], "left")
    place = F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(seed), "shard", "doc_id", "source", "mark", "x.pass"))
    # a document that is taken whole keeps what stands behind its last word
    text = F.when(F.col("x.words") == F.col("size"), F.col("text")).when(F.col("x.words") > 0, first_words(F.col("text"), F.col("x.words")))
    d = d.withColumn("text", text)
    words = F.coalesce("x.words", F.lit(0).cast("long"))
    return d.select("row", "doc_id", "source", "size", "source_size", "target", F.col("x.pass").alias("pass"), words.alias("words"), "shard", place.alias("place"), *carried)


def in_shards(mixed: DataFrame) -> DataFrame:
    """The draws, those of a shard in one partition and in the order of their places."""
    return mixed.where("shard is not null").repartition("shard").sortWithinPartitions("shard", "place")


#: Rounds in which shards are written: the shuffle of one is let go of before the next, so the disk never holds that of all texts.
WRITE_ROUNDS = 3


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as files, one folder a shard, each shuffled inside."""
    for k in range(WRITE_ROUNDS):
        in_shards(mixed.where(F.col("shard") % WRITE_ROUNDS == k)).write.partitionBy("shard").option("compression", "zstd").mode("append" if k else "errorifexists").parquet(path)
        scratch.let_go(mixed.sparkSession)
