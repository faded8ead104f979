"""Collects the registered queries of all catalog modules."""
from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ["metrilake.plans.catalog", "metrilake.plans.catalog_ingest", "metrilake.plans.catalog_alerts", "metrilake.plans.catalog_upkeep", "metrilake.plans.catalog_stream", "metrilake.plans.catalog_table", "metrilake.plans.catalog_rules",
           "metrilake.plans.catalog_cluster"]


def _load():
    q, s = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        q.update(mod.QUERIES)
        s.update(mod.SQL)
    return q, s


def queries():
    from ..session import ensure_conf
    q, _ = _load()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(v) for k, v in q.items()}


def oracle_sql():
    return dict(_load()[1])
