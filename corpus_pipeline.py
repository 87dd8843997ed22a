"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. Stages work on all rows they are given:

1. quality: a document that the byte-level network scores below one half goes;
2. language: a document whose language cannot be told (no text, no letter) goes; where
   lang is null it becomes the language told;
3. near_duplicates: of each group of documents that links of 75 % of their five-word
   shingles connect, the one with the smallest doc_id stays (ties: the smallest text
   hash); documents without words are all kept; of rows equal in doc_id and text one stays;
4. mixing: sources get their target weights; a document comes once per pass, so rows
   may repeat, and the end of a source's budget leaves documents out;
5. packing: one row per piece of a document, with its bin, offset and sequence length,
   all counted in ids of the tokenizer.

Models are trained in their stage on the labelled rows that may be learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agronimbus.llm import jaccard_join, language_id, mixing, packing, quality
from agronimbus.plans.storage import materialise, new_folder

#: Trained networks and permutations have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(*quality.learnable(spark, docs, sf_dir)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs.filter(~quality.held_out())))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs)
    kept = materialise(found.filter("kept").select(F.col("row_key").alias("_key")).distinct())
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole_row, jaccard_join.row_key(docs).alias("key"))
    rows = rows.join(kept, F.col("key") == F.col("_key"), "left_semi")
    # Joined by the key already, so this moves nothing.
    return rows.dropDuplicates(["key"]).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(packing.token_sizes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder."""
    folder = new_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
