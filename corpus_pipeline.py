"""A corpus from documents: language, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import made, materialise, release, without_spaces
from platen.llm.exact_dedup import exact_dedup
from platen.llm.jaccard_join import jaccard_components
from platen.llm.language import held_out, identify, train
from platen.llm.mixing import mix_sources
from platen.llm.packing import pack


#: Before the names of helper columns, so that no column of documents is hidden or met.
OWN = "__platen_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without letters. Repeated rows and ties are kept as they are."""
    model = train(docs.filter(~held_out()))
    return identify(docs, model, docs.columns).filter("lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; null texts count as empty. Of fully repeated rows one stays."""
    found = exact_dedup(docs)
    narrow = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("same")).filter("kept")
    narrow = materialise(narrow.select(F.col("doc_id").alias(f"{OWN}id"), F.col("text_sha256").alias(f"{OWN}sha"), F.col("same").alias(f"{OWN}same")), "kept")
    sha = F.sha2(without_spaces(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    joined = docs.join(narrow.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (sha == F.col(f"{OWN}sha")))
    several = F.col(f"{OWN}same") > 1
    if not narrow.filter(several).limit(1).count():
        return joined.select(*docs.columns)
    once = joined.filter(~several).select(*docs.columns)
    longest = F.max_by(F.struct(*docs.columns), F.length("text")).alias(f"{OWN}row")
    again = joined.filter(several).groupBy(f"{OWN}id", f"{OWN}sha").agg(longest).select(f"{OWN}row.*")
    return once.unionByName(again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the smallest; rows without an id or without words stay.

    Rows are told apart by id and text, so an id that repeats with another text
    loses only the row that is a copy; repeated rows stay or go together.
    """
    gone = jaccard_components(docs).filter("NOT kept").select(F.col("doc_id").alias(f"{OWN}id"), F.col("fp").alias(f"{OWN}fp")).distinct()
    gone = materialise(gone, "gone").hint("shuffle_hash")
    text_fp = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(f"{OWN}id")) & (text_fp == F.col(f"{OWN}fp")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: once for each epoch. Null texts have size 0 and are not taken; repeated ids go by the most that one of them is taken."""
    times = mix_sources(docs).filter("taken > 0").groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(f"{OWN}times"))
    times = materialise(times, "times")
    joined = docs.join(times.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")))
    return joined.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), f"{OWN}times"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; null and empty texts are one end mark, repeated rows are packed once each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", packing)]

#: Learnt models, hash orders and tokenizers can't be expressed in SQL: see tests/llm/test_private_shards_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one has read and written on its way goes when its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(spark, since, keep=1)
    return docs
