"""Token counts: the exact length histogram and what it answers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shared_table, small_batches
from .tokens import default_path, encoder

STEP = 1024                   # lengths in a block of the two-level sums


def token_counts(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens long, a row for each row of docs; null and empty texts have none.  Whole texts are encoded."""
    small_batches(docs.sparkSession)
    at = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(at)
        for batch in batches:
            n = np.fromiter((len(enc(t.as_py())) // 2 for t in batch.column(0)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["n_tokens"])

    return docs.select(F.col(text)).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each encoded length that occurs, with the sums that answer
    every question on lengths.

    n_tokens long, n_docs long, docs_upto long and tokens_upto long (of lengths
    up to it), docs_over long and tokens_over long (suffix sums, of lengths
    above it), truncated_total long (tokens left if every document is cut at
    n_tokens), share_upto double (so the q-quantile is the first row with
    share_upto >= q).

    Null and empty texts have length 0.  Copies and repeated rows count each.
    An empty table gives an empty result; other columns are ignored.  Documents
    are counted map-side, a row a length and task is shuffled; sums run over
    blocks of STEP lengths and then within blocks.
    """
    hist = token_counts(docs, text=text, path=path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    hist = shared_table(hist, "lengths")  # texts are encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / STEP)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block"))  # longest text / STEP rows at most
    blocks = blocks.select("block", (F.sum("bd").over(after) - F.col("bd")).alias("d_after"), (F.sum("bt").over(after) - F.col("bt")).alias("t_after"),
                           F.sum("bd").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_d"),
                           F.sum("bt").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_t"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = (hist.join(blocks, "block")
           .withColumn("docs_over", F.col("d_after") + F.sum("n_docs").over(inside) - F.col("n_docs"))
           .withColumn("tokens_over", F.col("t_after") + F.sum("tokens").over(inside) - F.col("tokens")))
    upto = F.col("all_d") - F.col("docs_over")
    left = F.col("all_t") - F.col("tokens_over")
    return out.select("n_tokens", "n_docs", upto.alias("docs_upto"), left.alias("tokens_upto"), "docs_over", "tokens_over",
                      (left + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
                      (upto / F.col("all_d")).alias("share_upto"))


def total(hist: DataFrame) -> int:
    """All tokens."""
    return hist.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0


def truncated(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (limit long) with total long: the tokens left when every document is cut at the limit.

    Any limit, whether a document has that length or not: the sums stand at the
    largest length that does not exceed it.  Null limits give null.
    """
    marks = hist.select(F.col("n_tokens").alias("at"), "tokens_upto", "docs_over", F.lit(None).cast("long").alias("limit"))
    n = hist.agg(F.sum("n_docs").alias("n"))
    zero = n.select(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("tokens_upto"), F.coalesce("n", F.lit(0)).alias("docs_over"),
                    F.lit(None).cast("long").alias("limit"))
    asked = limits.select(F.col("limit").alias("at"), F.lit(None).cast("long").alias("tokens_upto"), F.lit(None).cast("long").alias("docs_over"),
                          F.col("limit").cast("long"))
    order = Window.orderBy("at", F.col("limit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = (marks.unionByName(zero).unionByName(asked)
           .withColumn("t", F.last("tokens_upto", True).over(order)).withColumn("d", F.last("docs_over", True).over(order)))
    return met.filter("limit is not null").select("limit", (F.col("t") + F.col("limit") * F.col("d")).alias("total"))


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that a share of q of the documents does not exceed."""
    return hist.filter(F.col("share_upto") >= q).agg(F.min("n_tokens")).first()[0]
