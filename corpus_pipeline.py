"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Stages that take documents away decide for each row by itself, so null and
repeated ids need no care: rows are judged where they stand, or have a number
of their own while near-duplicates are looked for.  The columns of documents
pass through unchanged, whatever else they are called.

Defined results, for every stage: an empty table gives an empty one; null and
blank texts are kept by all but the mixture, which draws words and so never
draws them; very long texts are read whole; a null in any other column changes
nothing but the source, null being a source of its own; repeated rows have the
same fate, but for near-duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontam, mixing, neardup, pii, quality, scratch

#: Hashing, learning and sampling stages have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, for their quality or as toxic, go; a chance of just one half stays."""
    return quality.kept(docs, scratch.load(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the least id, nulls last, then by a hash of its text; of rows alike in both any one.

    A null or blank text is like no other, so all such rows stay.
    """
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("mark"))
    numbered = scratch.table(numbered, "numbered")
    groups = neardup.near_duplicates(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), percent=80)
    rows = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(numbered.select("row", F.col("doc.doc_id").alias("doc_id"), "mark"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "row"))
    stay = rows.groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(stay, "row", "left_semi").select([F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go; null and blank items are in none, and without items all stay."""
    return decontam.clean(docs, scratch.load(spark, sf_dir, "benchmark", "item_id", "text"), similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds, of spans that overlap the first; n_chars follows the text where it is known."""
    return _with_length(pii.redact(docs, docs.columns))


def _with_length(docs: DataFrame) -> DataFrame:
    """The documents with n_chars, where it is known, as their texts are now."""
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else docs


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each draw of a document, its text cut to the words drawn, gathered by shard in the order of its place there.

    n_chars follows the text.  A column of the mix whose name documents have
    already is called mix_<name>.  Rows of one id and text have one place, so
    their order among each other says nothing.
    """
    mixed = mixing.in_shards(mixing.mix_sources(docs))
    own = ("size", "source_size", "target", "pass", "words", "shard", "place")
    out = mixed.select(
        *[F.col(c) if c in ("doc_id", "text", "source") else F.col("other").getField(c).alias(c) for c in docs.columns],
        *[F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in own],
    )
    return _with_length(out)


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one returns."""
    docs = scratch.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch.place(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
