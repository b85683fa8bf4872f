"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hpylm, knn, mixing, neardup, pii, quality, scratch, substrings, tokencount


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(scratch.load(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=10, scale=1024, every=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.load(spark, sf_dir, "documents", "doc_id", "text")
    return tokencount.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.load(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, scratch.load(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, path = mixing.mix_sources(scratch.load(spark, sf_dir, "documents")), scratch.place(spark, "mix-shards")
    mixing.write_shards(mixed, path)
    # counted in the texts that were written
    words = F.regexp_count("text", F.lit(mixing.WORD)).cast("long")
    written = spark.read.schema(mixed.select("row", "text", "shard").schema).parquet(path)
    by = written.groupBy("row").agg(F.sum(words).alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    every = mixed.select("row", "doc_id", "size", "source_size", "target").distinct().join(by, "row", "left")
    return every.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(scratch.load(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(scratch.load(spark, sf_dir, "documents", "doc_id", "text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch.load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.digest(chat.render(chat.canonical(rows.unionByName(planted))))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.load(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.leaks(docs, scratch.load(spark, sf_dir, "benchmark", "item_id", "text"), similarity=0.8)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(scratch.load(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(scratch.load(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn_join": op1_knn_join,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_model": op5_language_model,
    "op6_pii": op6_pii,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_substrings": op10_repeated_substrings,
}

_KNN = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM e q JOIN e d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '\\', '\\e'), '<', '\\l'), '[', '\\b')"


_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, r, x))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(25 + length({_escaped('r')}) + length({_escaped('x')}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

_NEAR = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN (SELECT v, min(c) AS c FROM reach GROUP BY 1) m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: The other operators hash, learn, sample or match at positions; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_knn_join": _KNN, "op7_chat_format": _CHAT, "op9_near_duplicates": _NEAR}
