"""The registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm, sql, suffix_tree, turns
from .common import tables
from .golomb import exact_duplicates
from .html_text import extract
from .hyperminhash import near_duplicates
from .lengths import length_histogram
from .licenses import scan
from .mixing import mix
from .packing import pack
from .projection import near_vectors
from .shards import shard
from .whitening import whiten


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a Jaccard similarity of 0.85."""
    out = near_duplicates(tables(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op2_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by the weights 5, 2, 1 takes of each document."""
    out = mix(tables(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    return shard(tables(spark, sf_dir, "documents"), shards=40, overhead=16)


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, filled with lexical neighbours."""
    out = pack(tables(spark, sf_dir, "documents"), window=1024)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_duplicates(tables(spark, sf_dir, "documents"))


def op6_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of a label at a cosine of 0.93."""
    return near_vectors(tables(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = tables(spark, sf_dir, "documents")
    model = ppm.fit(docs.filter(~ppm.held_out("doc_id")), key=F.col("doc_id"))
    out = ppm.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", ppm.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that the sentences of every document name."""
    out = scan(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                      F.concat_ws(",", F.transform("sentence_ids", lambda i: i.cast("string"))).alias("sentence_ids"), "unmatched")


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents' token counts with its sums."""
    return length_histogram(tables(spark, sf_dir, "documents"))


def op10_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(tables(spark, sf_dir, "pages"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a suffix tree of six sevenths of them, and under their unigrams."""
    docs = tables(spark, sf_dir, "documents").withColumn("held_out", suffix_tree.held_out("doc_id"))
    tree, counts = suffix_tree.fit(docs.filter("not held_out"))
    return suffix_tree.score(docs, tree, counts, keep=["doc_id", "held_out"])


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first 16 whitened components."""
    out = whiten(tables(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return turns.repair(turns.damaged(tables(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash": op1_hyperminhash,
    "op2_water_filling": op2_water_filling,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_golomb_dedup": op5_golomb_dedup,
    "op6_projection_passes": op6_projection_passes,
    "op7_ppm_language": op7_ppm_language,
    "op8_license_rules": op8_license_rules,
    "op9_length_histogram": op9_length_histogram,
    "op10_tree_scoring": op10_tree_scoring,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_refined_whitening": op12_refined_whitening,
    "op13_turn_repair": op13_turn_repair,
}

SQL: dict[str, str] = {
    "op1_hyperminhash": sql.OP1,
    "op2_water_filling": sql.OP2,
    "op5_golomb_dedup": sql.OP5,
    "op6_projection_passes": sql.OP6,
    "op8_license_rules": sql.OP8,
    "op13_turn_repair": sql.OP13,
}
