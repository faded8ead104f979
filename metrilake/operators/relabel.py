"""Relabelling of map-labelled samples or targets: L1–L13.

A frame here carries all labels in one ``MAP<STRING,STRING>`` column (the
metric name under ``__name__``), as scraped.  Rules run in order, each seeing
the previous result; every rule is a column expression (``rlike``,
``regexp_replace``, ``map_filter``, ``transform``…), so a whole relabel list
stays inside one projection/filter – no shuffle, no Python.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "labels"


@dataclass(frozen=True)
class Rule:
    """One relabel step with the usual defaults (regex ``(.*)``, separator ``;``, replacement ``$1``)."""
    action: str = "replace"
    source_labels: Sequence[str] = ()
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"
    separator: str = ";"
    modulus: int = 0


def Keep(source_labels, regex, separator=";"):
    return Rule("keep", tuple(source_labels), regex, separator=separator)


def Drop(source_labels, regex, separator=";"):
    return Rule("drop", tuple(source_labels), regex, separator=separator)


def Replace(source_labels, target_label, regex="(.*)", replacement="$1", separator=";"):
    return Rule("replace", tuple(source_labels), regex, target_label, replacement, separator)


def LabelMap(regex, replacement="$1"):
    return Rule("labelmap", (), regex, replacement=replacement)


def LabelDrop(regex):
    return Rule("labeldrop", (), regex)


def LabelKeep(regex):
    return Rule("labelkeep", (), regex)


def HashMod(source_labels, target_label, modulus, separator=";"):
    return Rule("hashmod", tuple(source_labels), "(.*)", target_label, separator=separator, modulus=modulus)


def Lower(source_labels, target_label, separator=";"):
    return Rule("lowercase", tuple(source_labels), "(.*)", target_label, separator=separator)


def Upper(source_labels, target_label, separator=";"):
    return Rule("uppercase", tuple(source_labels), "(.*)", target_label, separator=separator)


def _anchor(rx: str) -> str:
    return f"^(?:{rx})$"


def _repl(r: str) -> str:
    # ${1} → $1 ; a literal "$" that is not a group reference stays escaped
    return re.sub(r"\$\{(\w+)\}", r"$\1", r)


def source_value(labels: Column, names: Sequence[str], sep: str) -> Column:
    parts = [F.coalesce(labels[n], F.lit("")) for n in names]
    return F.concat_ws(sep, *parts) if parts else F.lit("")


def set_label(labels: Column, name: Column | str, value: Column) -> Column:
    """labels with ``name`` set to ``value``; an empty value deletes the label."""
    name = F.lit(name) if isinstance(name, str) else name
    rest = F.map_filter(labels, lambda k, v: k != name)
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(name, value)))


def hash_mod(s: Column, modulus: int) -> Column:
    """Last 8 bytes of md5 as an unsigned 64-bit integer, modulo ``modulus`` (exact, via DECIMAL(20,0))."""
    big = F.conv(F.substring(F.md5(s), 17, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(big, F.lit(modulus).cast("decimal(20,0)")).cast("bigint")


def _apply(df: DataFrame, r: Rule, col: str) -> DataFrame:
    labels = F.col(col)
    pat = _anchor(r.regex)
    if r.action in ("keep", "drop"):
        src = source_value(labels, r.source_labels, r.separator)
        m = src.rlike(pat)
        return df.filter(m if r.action == "keep" else ~m)
    if r.action == "replace":
        src = source_value(labels, r.source_labels, r.separator)
        m = src.rlike(pat)
        val = F.regexp_replace(src, pat, _repl(r.replacement))
        tgt = F.regexp_replace(src, pat, _repl(r.target_label)) if "$" in r.target_label else F.lit(r.target_label)
        return df.withColumn(col, F.when(m, set_label(labels, tgt, val)).otherwise(labels))
    if r.action in ("lowercase", "uppercase"):
        src = source_value(labels, r.source_labels, r.separator)
        val = F.lower(src) if r.action == "lowercase" else F.upper(src)
        return df.withColumn(col, set_label(labels, r.target_label, val))
    if r.action == "hashmod":
        src = source_value(labels, r.source_labels, r.separator)
        return df.withColumn(col, set_label(labels, r.target_label, hash_mod(src, r.modulus).cast("string")))
    if r.action == "labelmap":
        # a new name takes its place behind the others each time it comes, so later entries win; each name is matched
        # and rewritten once, and the new labels, read twice, stay a column of their own
        named = F.transform(F.filter(F.map_entries(labels), lambda e: e["key"].rlike(pat)),
                            lambda e: F.struct(F.regexp_replace(e["key"], pat, _repl(r.replacement)).alias("key"), e["value"].alias("value")))
        new = F.aggregate(named, F.create_map().cast("map<string,string>"),
                          lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
        df = df.withColumn("_mapped", new)
        kept = F.map_filter(labels, lambda k, v: ~F.map_contains_key(F.col("_mapped"), k))      # new ones override existing labels
        return df.withColumn(col, F.map_concat(kept, F.col("_mapped"))).drop("_mapped")
    if r.action == "labeldrop":
        return df.withColumn(col, F.map_filter(labels, lambda k, v: ~k.rlike(pat)))
    if r.action == "labelkeep":
        return df.withColumn(col, F.map_filter(labels, lambda k, v: k.rlike(pat)))
    raise ValueError(f"unknown relabel action {r.action}")


def relabel(df: DataFrame, rules: Iterable[Rule], col: str = LABELS) -> DataFrame:
    """Apply the rules in order (L1–L8, L13 on an alerts frame)."""
    for r in rules:
        df = _apply(df, r, col)
    return df


def attach_target_labels(df: DataFrame, target: Column, honor: bool, col: str = LABELS) -> DataFrame:
    """Merge target labels into scraped labels.

    ``honor=True``: a scraped label wins.  ``honor=False``: the target label
    wins and a clashing scraped label is kept as ``exported_<name>``.
    """
    scraped = F.col(col)
    if honor:
        extra = F.map_filter(target, lambda k, v: ~F.map_contains_key(scraped, k))
        return df.withColumn(col, F.map_concat(scraped, extra))
    clash = F.map_filter(scraped, lambda k, v: F.map_contains_key(target, k) & (v != ""))
    renamed = F.transform_keys(clash, lambda k, v: F.concat(F.lit("exported_"), k))
    # an exported_<name> that the sample carries already gives way to the renamed label
    plain = F.map_filter(scraped, lambda k, v: ~F.map_contains_key(target, k) & ~F.map_contains_key(renamed, k))
    renamed = F.map_filter(renamed, lambda k, v: ~F.map_contains_key(target, k))
    return df.withColumn(col, F.map_concat(plain, renamed, target))


def with_external_labels(df: DataFrame, ext: dict, col: str = LABELS) -> DataFrame:
    """Add external labels a sample does not carry already."""
    m = F.create_map(*[x for k, v in ext.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(col, F.map_concat(F.col(col), F.map_filter(m, lambda k, v: ~F.map_contains_key(F.col(col), k))))


def enforce_label(df: DataFrame, name: str, value: str, col: str = LABELS) -> DataFrame:
    """Force ``name=value`` on every sample (L12, the enforced namespace label)."""
    return df.withColumn(col, set_label(F.col(col), name, F.lit(value)))


@dataclass(frozen=True)
class Limits:
    sample_limit: int = 0
    label_limit: int = 0
    label_name_length_limit: int = 0
    label_value_length_limit: int = 0


def enforce_limits(df: DataFrame, limits: Limits, scrape_keys: Sequence[str], col: str = LABELS):
    """Reject whole scrapes that break a limit (L11). Returns (accepted, rejected report).

    Per-sample checks are column expressions; the per-scrape sample count is
    one grouped count joined back on the scrape key (AQE broadcasts it when
    small – one row per scrape).
    """
    keys = list(scrape_keys)
    bad = F.lit(False)
    if limits.label_limit:
        bad = bad | (F.size(F.col(col)) > limits.label_limit)
    if limits.label_name_length_limit:
        bad = bad | F.exists(F.map_keys(F.col(col)), lambda k: F.length(k) > limits.label_name_length_limit)
    if limits.label_value_length_limit:
        bad = bad | F.exists(F.map_values(F.col(col)), lambda v: F.length(v) > limits.label_value_length_limit)
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"),
                                F.max(bad.cast("int")).alias("_bad_labels"))
    reason = (F.when(F.lit(limits.sample_limit > 0) & (F.col("samples") > limits.sample_limit), F.lit("sample_limit"))
              .when(F.col("_bad_labels") == 1, F.lit("label_limit")))
    per = per.withColumn("reason", reason).drop("_bad_labels")
    rejected = per.filter(F.col("reason").isNotNull())
    ok = df.join(rejected.select(*keys), on=keys, how="left_anti")
    return ok, rejected
