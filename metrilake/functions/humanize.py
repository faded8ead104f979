"""Annotation templating and number formatting: F1–F5.

Templates are compiled on the driver into one column expression
(``concat`` of literals and formatted columns), so rendering runs in the JVM
next to the alert rows.  Number formats follow the template language's
``%g``: shortest form with the given significant digits, no trailing zeros,
exponent form when the exponent is < -4 or ≥ the precision.  (Ties that are
exact in binary round half-up here, half-even there.)
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip_zeros(s: Column) -> Column:
    # "12.50" → "12.5", "100.000" → "100"; leaves integers untouched
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)


def go_g(x: Column, prec: int = 4) -> Column:
    """``%.{prec}g`` of a double.  The JVM's ``%g`` picks fixed or exponent form by the
    same rule (exponent of the rounded value in [-4, prec)) but keeps trailing zeros, which
    the template language drops: ``12.50`` → ``12.5``, ``1.000e+07`` → ``1e+07``."""
    p = max(prec, 1)
    s = F.format_string(f"%.{p}g", x)
    s = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(x == F.lit(float("inf")), F.lit("+Inf"))
            .when(x == F.lit(float("-inf")), F.lit("-Inf"))
            .when(x == 0, F.lit("0"))
            .otherwise(s))


def go_v(x: Column) -> Column:
    """Default float printing (``$value``): up to 15 significant digits in ``%g`` style,
    exponent form from 1e6 / below 1e-4 as the template language does."""
    s = go_g(x, 15)
    small_int = (x == F.floor(x)) & (F.abs(x) < 1e6)
    return F.when(small_int & ~F.isnan(x), x.cast("bigint").cast("string")).otherwise(s)


def humanize_pct(x: Column) -> Column:
    """``humanizePercentage``: ratio → ``%.4g%`` of ×100 (F2)."""
    return F.concat(go_g(x * 100, 4), F.lit("%"))


_BIG = ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]
_SMALL = ["", "m", "u", "n", "p", "f", "a", "z", "y"]


def humanize(x: Column) -> Column:
    """``humanize``: SI prefix by powers of 1000."""
    a = F.abs(x)
    up = F.least(F.floor(F.log10(a) / 3), F.lit(8)).cast("int")
    down = F.least(F.ceil(-F.log10(a) / 3), F.lit(8)).cast("int")
    big = F.concat(go_g(x / F.pow(F.lit(1000.0), up), 4), F.element_at(F.array(*[F.lit(p) for p in _BIG]), up + 1))
    small = F.concat(go_g(x * F.pow(F.lit(1000.0), down), 4),
                     F.element_at(F.array(*[F.lit(p) for p in _SMALL]), down + 1))
    return (F.when((x == 0) | F.isnan(x) | (a == F.lit(float("inf"))), go_g(x, 4))
            .when(a >= 1, big).otherwise(small))


def humanize_duration(x: Column) -> Column:
    """``humanizeDuration``: seconds → ``1d 2h 3m 4s`` / ``12.5s`` / ``250ms``."""
    a = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    d = F.floor(a).cast("bigint")
    s, m, h, days = d % 60, (d / 60).cast("bigint") % 60, (d / 3600).cast("bigint") % 24, (d / 86400).cast("bigint")
    long = (F.when(days != 0, F.format_string("%s%dd %dh %dm %ds", sign, days, h, m, s))
            .when(h != 0, F.format_string("%s%dh %dm %ds", sign, h, m, s))
            .when(m != 0, F.format_string("%s%dm %ds", sign, m, s))
            .otherwise(F.concat(sign, go_g(a, 4), F.lit("s"))))
    k = F.least(F.ceil(-F.log10(a) / 3), F.lit(3)).cast("int")
    sub = F.concat(go_g(x * F.pow(F.lit(1000.0), k), 4), F.element_at(F.array(F.lit(""), F.lit("m"), F.lit("u"), F.lit("n")), k + 1),
                   F.lit("s"))
    return (F.when(F.isnan(x) | (a == F.lit(float("inf"))), go_g(x, 4))
            .when(x == 0, F.lit("0s"))
            .when(a >= 1, long).otherwise(sub))


_PRINTF = re.compile(r'^printf\s+"(%[0-9]*\.?[0-9]*[fgde])"\s+(\$value|\$labels\.\w+)$')
_PIPE = re.compile(r'^(\$value|\$labels\.\w+|"[^"]*")\s*\|\s*(humanizePercentage|humanizeDuration|humanize)$')


def _operand(tok: str, value_col: str) -> Column:
    if tok == "$value":
        return F.col(value_col)
    if tok.startswith("$labels."):
        return F.col(tok[len("$labels."):]).try_cast("double")
    return F.lit(float(tok.strip('"')))


def _action(expr: str, value_col: str) -> Column:
    expr = expr.strip()
    if expr == "$value":
        return go_v(F.col(value_col))
    if expr.startswith("$labels."):
        return F.coalesce(F.col(expr[len("$labels."):]).cast("string"), F.lit(""))
    m = _PRINTF.match(expr)
    if m:
        fmt, arg = m.groups()
        v = _operand(arg, value_col)
        if fmt.endswith("g"):
            digits = re.search(r"\.(\d+)", fmt)
            return go_g(v, int(digits.group(1)) if digits else 6)
        return F.format_string(fmt.replace("%0.", "%."), v)
    m = _PIPE.match(expr)
    if m:
        arg, fn = m.groups()
        v = _operand(arg, value_col)
        return {"humanizePercentage": humanize_pct, "humanizeDuration": humanize_duration,
                "humanize": humanize}[fn](v)
    raise ValueError(f"unsupported template action {{{{ {expr} }}}}")


def render(template: str, value_col: str = "value") -> Column:
    """Compile an annotation template into a column expression (F1)."""
    parts, pos = [], 0
    for m in re.finditer(r"\{\{-?\s*(.*?)\s*-?\}\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(_action(m.group(1), value_col))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def legend(fmt: str) -> Column:
    """Series display name from ``{{label}}`` placeholders."""
    parts, pos = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", fmt):
        if m.start() > pos:
            parts.append(F.lit(fmt[pos:m.start()]))
        parts.append(F.coalesce(F.col(m.group(1)).cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(fmt):
        parts.append(F.lit(fmt[pos:]))
    return F.concat(*parts) if parts else F.lit("")
