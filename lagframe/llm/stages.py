"""Stages of the pipeline: ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, toxicity
from .ngram_join import ngram_jaccard_join
from .scratch import store
from .substring_dedup import substring_dedup

#: Wanted token shares of the mixing stage, and the wanted total by all tokens. No document is taken twice, so of good text,
#: of which more is asked for than there is, all stays, and likely low-quality text is thinned.
WEIGHTS, BUDGET = {"good": 0.97, "low": 0.03}, 1.1


def _same_row(own: DataFrame, other: DataFrame) -> Column:
    """Equal ids, or none on both sides, and equal texts."""
    return own["doc_id"].eqNullSafe(other["doc_id"]) & (own["text_hash"] == other["text_hash"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger, learned from this stage's labelled documents, rejects go, those without an id too."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = toxicity.score(docs, model, hashes=True).where("predicted = 1").select("doc_id", "text_hash").distinct()
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    return own.join(bad, _same_row(own, bad), "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays; rows without a shingle stay.
    Of an id with several texts only the texts that have a smaller id in their group go."""
    ids = ngram_jaccard_join(docs, k=5, threshold="0.8", hashes=True)
    others = ids.where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    return own.join(others, _same_row(own, others), "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has go; a document without any word left goes too.

    Rows without an id, null texts and texts without such a passage stay as they are; repeated rows are cut alike, and each stays.
    """
    cut = substring_dedup(docs).where("n_removed > 0").select("doc_id", "h", "kept").dropDuplicates(["doc_id", "h"])
    own = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).join(cut, ["doc_id", "h"], "left").where("kept is null or kept <> ''")
    text = F.coalesce("kept", "text")
    return own.withColumn("n_chars", F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rate rounds to none go, and the others stay once: likely low-quality text is thinned, clean text is kept.
    Rows of one id and text stay or go together; null ids and texts are rated like any other."""
    rated = mixing.mix(docs, mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), WEIGHTS, BUDGET)
    gone = store(rated.where("copies = 0").select("doc_id", "text_hash").distinct())
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    return own.join(gone, _same_row(own, gone), "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids in sequences of 2048, a row a piece; nulls, empty texts, repeated rows and other columns as in
    :func:`~lagframe.llm.packing.packing`."""
    return packing.packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]
