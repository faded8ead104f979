"""Metrics topic source and batched sample sink.

Records are JSON ``{"metric", "labels", "ts", "value"}``.  On a cluster the
source is the Kafka topic; the connector jar is not part of this image, so
``read_metric_topic`` accepts any streaming DataFrame with a string ``value``
column (tests use a file stream of the same records).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "metric string, labels map<string,string>, ts bigint, value double"


def read_metric_topic(spark: SparkSession, brokers: str | None = None, topic: str | None = None,
                      source: DataFrame | None = None, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming samples from the topic (or from ``source`` with a ``value`` string column)."""
    if source is None:
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
             .option("subscribe", topic).option("startingOffsets", "earliest"))
        if max_offsets_per_trigger:
            r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
        source = r.load().select(F.col("value").cast("string").alias("value"))
    parsed = source.select(F.from_json(F.col("value"), RECORD_SCHEMA).alias("r")).select("r.*")
    return parsed.filter(F.col("metric").isNotNull() & F.col("ts").isNotNull())


def to_records(samples: DataFrame) -> DataFrame:
    """Samples (metric, labels, ts, value) → one JSON string per record."""
    return samples.select(F.to_json(F.struct("metric", "labels", "ts", "value")).alias("value"))


def write_samples_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Add micro-batches to the partitioned block store.

    ``foreachBatch`` may run a batch again after a failure, so a batch owns the
    folder of its id (partition column ``batch``) and overwrites it: a replay leaves
    the store unchanged.
    """
    from .store import series_id, write_samples

    def sink(df: DataFrame, epoch: int):
        d = df.withColumn("series_id", series_id(F.col("metric"), F.col("labels")))
        (d.withColumn("resolution", F.lit("raw")).withColumn("date", F.to_date(F.timestamp_millis("ts")))
          .sortWithinPartitions("metric", "series_id", "ts")
          .write.mode("overwrite").partitionBy("resolution", "date").parquet(f"{path}/batch={epoch}"))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
