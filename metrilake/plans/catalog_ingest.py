"""Registered queries for relabelling (L*) and sources/sinks (S*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import api as A
from ..frame import TS, VALUE
from ..operators import relabel as R
from ..session import shared_dir
from ..sources import exposition, graphite, store
from ..sources import tables as T
from . import configs as C
from . import fixtures as X
from .catalog import rnd, G1D, G6H, out
from . import sqlgen as S

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- DuckDB twins of the derived inputs ----------------------------------------------
POD_SQL = """(SELECT c_custkey AS target_id,
  '10.0.' || CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN ':8080' ELSE '' END AS addr,
  'ns-' || CAST(c_nationkey AS VARCHAR) AS ns, c_name AS pod,
  CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END AS scrape,
  CAST(9000 + c_nationkey AS VARCHAR) AS port,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '/jmx' ELSE '' END AS path,
  lower(c_mktsegment) AS app, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)"""

TARGET_OUT = ["target_id", "address", "metrics_path", "kubernetes_namespace", "kubernetes_pod_name", "app", "nation",
              "n_labels"]


def _target_cols(df):
    m = F.col("labels")
    return df.select("target_id", F.coalesce(m["__address__"], F.lit("")).alias("address"),
                     F.coalesce(m["__metrics_path__"], F.lit("")).alias("metrics_path"),
                     F.coalesce(m["kubernetes_namespace"], F.lit("")).alias("kubernetes_namespace"),
                     F.coalesce(m["kubernetes_pod_name"], F.lit("")).alias("kubernetes_pod_name"),
                     F.coalesce(m["app"], F.lit("")).alias("app"), F.coalesce(m["nation"], F.lit("")).alias("nation"),
                     F.size(m).cast("bigint").alias("n_labels"))


@register("l_relabel_scrape_job", f"""
SELECT target_id,
  CASE WHEN regexp_full_match(addr || ';' || port, '([^:]+)(?::\\d+)?;(\\d+)')
       THEN regexp_replace(addr || ';' || port, '^([^:]+)(?::\\d+)?;(\\d+)$', '\\1:\\2') ELSE addr END AS address,
  CASE WHEN regexp_full_match(path, '.+') THEN path ELSE '' END AS metrics_path,
  ns AS kubernetes_namespace, pod AS kubernetes_pod_name, app, nation,
  CAST(7 + CASE WHEN path <> '' THEN 2 ELSE 0 END + 2 + 2 AS BIGINT) AS n_labels
FROM {POD_SQL} WHERE scrape = 'true'""")
def q_l_relabel_scrape_job(spark, sf):
    """keep / replace (capture groups) / labelmap over discovered pods (L1, L3, L4)."""
    return _target_cols(R.relabel(X.pod_targets(spark, sf), C.SPARK_PODS_JMX))


@register("l_labeldrop_keep_case", f"""
SELECT target_id, upper(ns) AS ns_upper, CAST(6 AS BIGINT) AS n_labels FROM {POD_SQL}""")
def q_l_labeldrop_keep_case(spark, sf):
    """labeldrop annotations, uppercase a label, labelkeep the rest."""
    rules = [R.LabelDrop("__meta_kubernetes_pod_annotation_.*"),
             R.Upper(["__meta_kubernetes_namespace"], "ns_upper"),
             R.LabelKeep("__address__|__meta_kubernetes_.*|ns_upper")]
    d = R.relabel(X.pod_targets(spark, sf), rules)
    return d.select("target_id", F.col("labels")["ns_upper"].alias("ns_upper"),
                    F.size("labels").cast("bigint").alias("n_labels"))


@register("l_hashmod", f"""
SELECT target_id, CAST((('0x' || substr(md5(addr), 17))::UBIGINT) % 7 AS VARCHAR) AS shard FROM {POD_SQL}""")
def q_l_hashmod(spark, sf):
    """hashmod of the address into 7 shards."""
    d = R.relabel(X.pod_targets(spark, sf), [R.HashMod(["__address__"], "__tmp_hash", 7)])
    return d.select("target_id", F.col("labels")["__tmp_hash"].alias("shard"))


EXPO_SQL = """(SELECT CASE event_type WHEN 'click' THEN 'container_cpu_usage_seconds_total'
  WHEN 'error' THEN 'container_cpu_user_seconds_total' WHEN 'purchase' THEN 'container_memory_swap'
  WHEN 'signup' THEN 'container_spec_cpu_shares'
  ELSE 'metrics_application_1704067200_0001_executor_bytesRead_total' END AS name,
  '/kubepods/' || CAST(user_id AS VARCHAR) AS id,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'pod-' || CAST(user_id AS VARCHAR) END AS pod,
  CASE WHEN event_id % 2 = 0 THEN '0.2' ELSE '1' END AS le,
  epoch_us(ts) // 1000 AS ts, value FROM events)"""


@register("s3_exposition", f"SELECT name, pod, ts, value FROM {EXPO_SQL}")
def q_s3_exposition(spark, sf):
    """Exposition text → samples; comment lines skipped (S3)."""
    d = exposition.read_exposition(X.exposition_lines(spark, sf))
    return d.select(F.col("labels")["__name__"].alias("name"), F.col("labels")["pod"].alias("pod"),
                    F.col("ts"), F.col("value"))


@register("l_metric_relabel_and_drop", f"""
SELECT CASE WHEN regexp_full_match(name, 'metrics_application_[0-9]+_[0-9]+_(.+)')
            THEN regexp_replace(name, '^metrics_application_[0-9]+_[0-9]+_(.+)$', 'spark_\\1') ELSE name END AS name,
       CAST(COUNT(*) AS BIGINT) AS samples, ROUND(SUM(value), 6) AS value
FROM {EXPO_SQL} WHERE NOT regexp_full_match(name, 'container_cpu_(cfs_throttled_seconds_total|load_average_10s|system_seconds_total|user_seconds_total)')
  AND NOT regexp_full_match(name, 'container_memory_(mapped_file|swap)') AND NOT regexp_full_match(name, 'container_spec.*')
  AND pod <> ''
GROUP BY 1""")
def q_l_metric_relabel_and_drop(spark, sf):
    """Ingest drops (L2, incl. the two-label ``id;pod`` rule) then the metric rename (L3 on __name__)."""
    d = exposition.read_exposition(X.exposition_lines(spark, sf))
    d = R.relabel(d, C.CADVISOR_DROP + C.APISERVER_DROP + C.SPARK_METRIC_RELABEL)
    return (d.groupBy(F.col("labels")["__name__"].alias("name"))
             .agg(F.count(F.lit(1)).alias("samples"), rnd(F.sum("value"), 6).alias("value")))


@register("l_honor_external_enforce", f"""
SELECT pod, exported_pod, namespace, cluster, CAST(COUNT(*) AS BIGINT) AS samples FROM (
  SELECT 'target-' || CAST(user_id % 5 AS VARCHAR) AS pod,
         CASE WHEN user_id % 10 = 0 THEN '' ELSE 'pod-' || CAST(user_id AS VARCHAR) END AS exported_pod,
         'enforced' AS namespace, 'c1' AS cluster FROM events) GROUP BY ALL""")
def q_l_honor_external_enforce(spark, sf):
    """Target labels without honor_labels (clash → exported_*), external labels, enforced namespace."""
    e = T.table(spark, sf, "events")
    d = exposition.read_exposition(X.exposition_lines(spark, sf))
    d = d.withColumn("_uid", F.regexp_extract(F.col("labels")["id"], r"(\d+)$", 1).cast("bigint"))
    target = F.create_map(F.lit("pod"), F.concat(F.lit("target-"), (F.col("_uid") % 5).cast("string")))
    d = R.attach_target_labels(d, target, honor=False)
    d = R.with_external_labels(d, {"cluster": "c1", "pod": "ignored"})
    d = R.enforce_label(d, "namespace", "enforced")
    m = F.col("labels")
    return (d.select(m["pod"].alias("pod"), F.coalesce(m["exported_pod"], F.lit("")).alias("exported_pod"),
                     m["namespace"].alias("namespace"), m["cluster"].alias("cluster"))
             .groupBy("pod", "exported_pod", "namespace", "cluster").agg(F.count(F.lit(1)).alias("samples")))


@register("l_enforce_limits", """
SELECT pod, CAST(COUNT(*) AS BIGINT) AS samples FROM (
  SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE 'pod-' || CAST(user_id AS VARCHAR) END AS pod FROM events)
GROUP BY pod HAVING COUNT(*) <= 80""")
def q_l_enforce_limits(spark, sf):
    """Per-scrape sample limit: scrapes (here: per pod) over 80 samples are rejected whole."""
    d = exposition.read_exposition(X.exposition_lines(spark, sf))
    d = d.withColumn("pod", F.coalesce(F.col("labels")["pod"], F.lit("")))
    ok, _rej = R.enforce_limits(d, R.Limits(sample_limit=80, label_limit=10, label_value_length_limit=200), ["pod"])
    return ok.groupBy("pod").agg(F.count(F.lit(1)).alias("samples"))


def _graphite_sql():
    # template choice as a CASE over path parts (DuckDB lists are 1-based)
    p = "string_split(path, '.')"
    return f"""
WITH l AS (SELECT event_id, split_part(value, ' ', 1) AS path, CAST(split_part(value, ' ', 2) AS DOUBLE) AS value,
                  CAST(split_part(value, ' ', 3) AS BIGINT) * 1000 AS ts FROM ({X.GRAPHITE_SQL})),
p AS (SELECT *, {p} AS a FROM l)
SELECT event_id, ts, value,
 CASE WHEN a[3] = 'jvm' AND a[4] = 'pools' THEN array_to_string(a[6:], '.')
      WHEN a[3] = 'applicationMaster' THEN array_to_string(a[4:], '.')
      WHEN a[2] = 'shuffleService' THEN array_to_string(a[3:], '.')
      WHEN a[4] = 'spark' AND a[5] = 'streaming' THEN array_to_string(a[7:], '.')
      ELSE array_to_string(a[5:], '.') END AS measurement,
 a[1] AS username,
 CASE WHEN a[2] = 'shuffleService' THEN '' ELSE a[2] END AS applicationid,
 CASE WHEN a[3] = 'applicationMaster' OR a[2] = 'shuffleService' THEN '' ELSE a[3] END AS process,
 CASE WHEN a[3] = 'jvm' AND a[4] = 'pools' THEN a[4] || '.' || a[5]
      WHEN a[3] = 'applicationMaster' THEN a[3] WHEN a[2] = 'shuffleService' THEN a[2]
      WHEN a[4] = 'spark' AND a[5] = 'streaming' THEN a[4] || '.' || a[5] ELSE a[4] END AS namespace,
 CASE WHEN a[4] = 'spark' AND a[5] = 'streaming' THEN a[6] ELSE '' END AS id
FROM p"""


@register("s1_graphite_templates", _graphite_sql())
def q_s1_graphite_templates(spark, sf):
    """Graphite lines → measurement + positional tags by the most specific template."""
    d = graphite.read_graphite(X.graphite_lines(spark, sf), C.GRAPHITE_TEMPLATES)
    return d.select("event_id", "ts", "value", "measurement", "username", "applicationid", "process", "namespace", "id")


@register("s6_store_roundtrip", S.final(S.agg(S.instant(S.view("m_gauge"), ["event_type", "user_id"], G1D,
                                                        86_400_000), "sum", ["event_type"]), ["event_type"]))
def q_s6_store_roundtrip(spark, sf):
    """Write samples as day-partitioned blocks, read a window back with partition pruning."""
    import uuid
    root = shared_dir(spark, f"blocks-{uuid.uuid4().hex[:8]}")
    samples = store.to_samples(T.m_gauge(spark, sf), metric="events_value")
    store.write_samples(samples, root, mode="overwrite")
    back = store.read_samples(spark, root, "events_value", G1D.start, G1D.end, lookback="1d")
    mf = store.frame(back, ["event_type", "user_id"]).drop_name()
    return out(A.aggregate(A.instant(mf, G1D, "1d"), "sum", by=["event_type"]))


@register("s9_union_stores", S.final(
    f"(SELECT event_type, '' AS user_id, ts, value FROM {S.instant(S.view('m_counter'), ['event_type'], G6H, 86_400_000)} "
    f"UNION ALL SELECT event_type, user_id, ts, value FROM {S.instant(S.view('m_user_counter'), ['event_type', 'user_id'], G6H, 86_400_000)})",
    ["event_type", "user_id"]))
def q_s9_union_stores(spark, sf):
    """Fan-out read over two stores with different label sets."""
    a = A.instant(T.m_counter(spark, sf), G6H, "1d")
    b = A.instant(T.m_user_counter(spark, sf), G6H, "1d")
    return out(store.union_stores(a, b))


@register("s10_record", S.final(
    f"(SELECT 'event_type:value:sum' AS __name__, event_type, 'events' AS source, ts, value FROM "
    f"{S.agg(S.instant(S.view('m_gauge'), ['event_type', 'user_id'], G6H, 86_400_000), 'sum', ['event_type'])})",
    ["__name__", "event_type", "source"]))
def q_s10_record(spark, sf):
    """Recording-rule output: renamed series with a static label."""
    s = A.aggregate(A.instant(T.m_gauge(spark, sf), G6H, "1d"), "sum", by=["event_type"])
    return out(store.record(s, "event_type:value:sum", {"source": "events"}))


@register("s11_label_values", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'purchase'""")
def q_s11_label_values(spark, sf):
    """Variable values: ``label_values(m_gauge{event_type="purchase"}, user_id)``."""
    return store.label_values(A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}), "user_id")


@register("s4_s5_topic_to_store", S.final(S.agg(S.instant(S.view("m_gauge"), ["event_type", "user_id"], G1D,
                                                          86_400_000), "sum", ["event_type"]), ["event_type"]))
def q_s4_s5_topic_to_store(spark, sf):
    """Topic → stream → batched block-store sink → windowed read.

    The producer side publishes ``events`` as JSON records into the topic folder; the
    stream is parsed by ``read_metric_topic`` and written by the sink, a batch in a
    folder of its own; the store is then read back for the
    evaluation window and aggregated."""
    import uuid
    from ..sources import topic
    root = shared_dir(spark, f"topic-{uuid.uuid4().hex[:8]}")
    samples = store.to_samples(T.m_gauge(spark, sf), metric="events_value")
    topic.to_records(samples).write.text(root + "/topic")
    src = spark.readStream.schema("value string").text(root + "/topic")
    q = topic.write_samples_stream(topic.read_metric_topic(spark, source=src), root + "/store",
                                   root + "/checkpoint")
    q.awaitTermination()
    back = store.read_samples(spark, root + "/store", "events_value", G1D.start, G1D.end, lookback="1d")
    mf = store.frame(back, ["event_type", "user_id"]).drop_name()
    return out(A.aggregate(A.instant(mf, G1D, "1d"), "sum", by=["event_type"]))
