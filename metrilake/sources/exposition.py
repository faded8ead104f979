"""Exposition-text ingest (S3): ``name{l="v",…} value [timestamp_ms]``.

Comment lines (``# HELP`` / ``# TYPE``) and malformed lines are skipped; the
label block becomes a MAP with ``__name__`` added, ready for relabelling.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(.*)\})?\s+(\S+)(\s+(-?\d+))?\s*$'
_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def _num(s):
    t = F.lower(s)
    return (F.when(t.isin("+inf", "inf"), F.lit(float("inf")))
            .when(t == "-inf", F.lit(float("-inf")))
            .when(t == "nan", F.lit(float("nan")))
            .otherwise(s.try_cast("double")))


def read_exposition(lines: DataFrame, col: str = "value", scrape_ts=None) -> DataFrame:
    """Lines → (labels MAP incl. __name__, ts ms, value).  ``scrape_ts`` fills missing timestamps."""
    line = F.trim(F.col(col))
    d = lines.select(line.alias("_l")).filter(~F.col("_l").startswith("#") & (F.col("_l") != ""))
    d = d.filter(F.col("_l").rlike(_LINE))
    name = F.regexp_extract("_l", _LINE, 1)
    block = F.regexp_extract("_l", _LINE, 3)
    keys = F.regexp_extract_all(block, F.lit(_PAIR), 1)
    vals = F.transform(F.regexp_extract_all(block, F.lit(_PAIR), 2),
                       lambda v: F.regexp_replace(F.regexp_replace(v, r'\\"', '"'), r'\\\\', r'\\'))
    labels = F.map_concat(F.create_map(F.lit("__name__"), name), F.map_from_arrays(keys, vals))
    tsx = F.regexp_extract("_l", _LINE, 6)
    ts = F.when(tsx != "", tsx.cast("bigint"))
    if scrape_ts is not None:
        ts = F.coalesce(ts, F.lit(scrape_ts).cast("bigint"))
    out = d.select(labels.alias("labels"), ts.alias("ts"), _num(F.regexp_extract("_l", _LINE, 4)).alias("value"))
    return out.filter(F.col("value").isNotNull())
