"""The corpus pipeline: stages over the documents table, each written as
Parquet and read again as the next one's documents.

Language ID, exact dedup, MinHash near-dedup, mixing to target weights and
packing, in this order.  A stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents.  Every stage
works on all rows that the one before kept; rows of equal doc_id are distinct
documents.  An empty table passes through all stages; extra columns of docs
are not carried on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilake.llm import ppm
from metrilake.llm.common import maybe_in, normal, shared_table
from metrilake.llm.golomb import exact_duplicates
from metrilake.llm.hyperminhash import near_duplicates
from metrilake.llm.mixing import mixed
from metrilake.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document whose best code takes more bits than its raw bytes is in none of
#: the learned languages.
MOST_BITS = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, without a letter or in none of the learned languages go.

    The prediction replaces lang where the table has none; a given lang stays.
    The model learns from the rows that have a language; where none has, only
    documents without a letter go.
    """
    model = ppm.fit(docs, key=F.col("doc_id"))
    seen = ppm.identify(docs, model, keep=COLUMNS)
    kept = seen.filter((F.col("lang_pred") != "und") & (F.col("bits") <= MOST_BITS)) if model.langs else seen.filter(F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return _stay(docs, exact_duplicates(docs).withColumnRenamed("kept", "first"), F.sha2(normal(F.col("text")), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    return _stay(docs, near_duplicates(docs, width=5, percent=80), F.sha2(F.coalesce("text", F.lit("")), 256))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the weights 5, 2, 1 to 150 % of all words, at most two epochs; a document stands as often as it is taken."""
    return mixed(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, epochs=2.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; uid tells the copies of a document apart."""
    return pack(docs, window=1024)


def _stay(docs: DataFrame, decided: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs that decided (doc_id, text_sha256, first) lets stay.

    Rows are known by doc_id and digest; of rows alike in both, one stays.  Only
    rows that may have to go are shuffled with their texts.
    """
    same = decided.groupBy("doc_id", "text_sha256").agg(F.max("first").alias("_first"), F.count(F.lit(1)).alias("_n"))
    odd = shared_table(same.filter("not _first or _n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256"), "_first"), "odd")
    maybe = maybe_in(odd.select(F.xxhash64("_id").alias("fp")))
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("_fp"))
    clear = rows.filter(~maybe("_fp"))
    asked = rows.filter(maybe("_fp")).withColumn("_digest", digest).join(
        odd, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha256")), "left")
    plain = asked.filter("_first is null")
    again = asked.filter("_first").dropDuplicates(["doc_id", "_digest"])
    return clear.select(*COLUMNS).unionByName(plain.select(*COLUMNS)).unionByName(again.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Language models, sketches and tokenizers are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
