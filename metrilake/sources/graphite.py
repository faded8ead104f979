"""Graphite plaintext ingest with tag templates.

A line is ``<dotted.path> <value> <epoch seconds>``.  A template is a filter
(dot tokens, ``*`` = any token, matched against a prefix of the path) and a
positional tag pattern; of the templates whose filter matches, the most
specific wins (most literal tokens, then most tokens, then list order); the
template without a filter is the default.  Repeated tag names join their parts
with the separator, and ``measurement*`` takes the rest of the path.

All of it is ``split`` + array/element expressions in one projection.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_NAMES = ("username", "applicationid", "process", "namespace", "id")


@dataclass(frozen=True)
class Template:
    filter: str | None
    pattern: str

    @staticmethod
    def parse(text: str) -> "Template":
        parts = text.split()
        return Template(parts[0], parts[1]) if len(parts) == 2 else Template(None, parts[0])

    @property
    def specificity(self):
        if self.filter is None:
            return (-1, -1)
        toks = self.filter.split(".")
        return (sum(t != "*" for t in toks), len(toks))


def _matches(parts: Column, t: Template) -> Column:
    if t.filter is None:
        return F.lit(True)
    toks = t.filter.split(".")
    cond = F.size(parts) >= len(toks)
    for i, tok in enumerate(toks):
        if tok != "*":
            cond = cond & (F.try_element_at(parts, F.lit(i + 1)) == F.lit(tok))
    return cond


def _extract(parts: Column, t: Template, sep: str):
    """(measurement, {tag: value}) columns for template ``t``."""
    names = t.pattern.split(".")
    by_name: dict[str, list[int]] = {}
    meas_pos: list[int] = []
    tail_from = None
    for i, n in enumerate(names):
        if n == "measurement*":
            tail_from = i
            break
        if n == "measurement":
            meas_pos.append(i)
        elif n:
            by_name.setdefault(n, []).append(i)
    pieces = [F.try_element_at(parts, F.lit(i + 1)) for i in meas_pos]
    if tail_from is not None:
        pieces.append(F.array_join(F.slice(parts, tail_from + 1, F.greatest(F.size(parts) - tail_from, F.lit(1))), sep))
    meas = F.concat_ws(sep, *pieces) if pieces else F.lit("")
    tags = {n: F.concat_ws(sep, *[F.try_element_at(parts, F.lit(i + 1)) for i in pos]) for n, pos in by_name.items()}
    return meas, tags


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split plaintext lines → (path, value, ts ms); malformed lines are dropped."""
    f = F.split(F.trim(F.col(col)), r"\s+")
    extra = [c for c in lines.columns if c != col]
    d = lines.select(*extra, F.element_at(f, 1).alias("path"), F.element_at(f, 2).try_cast("double").alias("value"),
                     F.element_at(f, 3).try_cast("double").alias("_sec"), F.size(f).alias("_n"))
    d = d.filter((F.col("_n") == 3) & F.col("value").isNotNull() & F.col("_sec").isNotNull())
    return d.select(*extra, "path", "value", (F.col("_sec") * 1000).cast("bigint").alias("ts"))


def apply_graphite_templates(df: DataFrame, templates, separator: str = ".", path: str = "path") -> DataFrame:
    """path → measurement + tag columns (one per tag name used by any template)."""
    ts = [Template.parse(t) if isinstance(t, str) else t for t in templates]
    order = sorted(range(len(ts)), key=lambda i: (ts[i].specificity[0], ts[i].specificity[1], -i), reverse=True)
    parts = F.split(F.col(path), r"\.")
    all_tags = sorted({n for t in ts for n in _extract(parts, t, separator)[1].keys()})
    meas_expr = None
    tag_expr = {n: None for n in all_tags}
    for i in reversed(order):          # build the when-chain so that order[0] is tested first
        t = ts[i]
        m, tags = _extract(parts, t, separator)
        cond = _matches(parts, t)
        meas_expr = F.when(cond, m) if meas_expr is None else F.when(cond, m).otherwise(meas_expr)
        for n in all_tags:
            v = tags.get(n, F.lit(""))
            tag_expr[n] = F.when(cond, v) if tag_expr[n] is None else F.when(cond, v).otherwise(tag_expr[n])
    out = df.withColumn("measurement", meas_expr)
    for n in all_tags:
        out = out.withColumn(n, F.coalesce(tag_expr[n], F.lit("")))
    return out.filter(F.col("measurement").isNotNull())


def read_graphite(lines: DataFrame, templates, col: str = "value", separator: str = ".") -> DataFrame:
    """Lines → samples with measurement, tags, ts (ms) and value (S1+S2)."""
    return apply_graphite_templates(parse_lines(lines, col), templates, separator)
