"""Label matchers (=, !=, =~, !~) as Spark column predicates.

Regexes are fully anchored and an absent label is "" – so ``a=~"x|"`` also
keeps rows without ``a``.  A regex that is a plain alternation of literals is
rewritten to ``isin`` so that the predicate reaches the Parquet scan.
"""
from __future__ import annotations

import re
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set(".^$*+?()[]{}|\\")


def anchored(regex: str) -> str:
    return f"^(?:{regex})$"


def literal_alternatives(regex: str) -> list[str] | None:
    """'GET|LIST' → ['GET', 'LIST']; None when the regex has other syntax."""
    parts = regex.split("|")
    out = []
    for p in parts:
        if any(ch in _META for ch in p):
            return None
        out.append(p)
    return out


def matches(col: Column, regex: str) -> Column:
    lits = literal_alternatives(regex)
    if lits is not None:
        return col.isin(*lits) if len(lits) > 1 else (col == lits[0])
    return col.rlike(anchored(regex))


def predicate(eq: Mapping[str, str] | None = None, ne: Mapping[str, str] | None = None,
              re_: Mapping[str, str] | None = None, nre: Mapping[str, str] | None = None) -> Column:
    cond = F.lit(True)
    for k, v in (eq or {}).items():
        cond = cond & (F.col(k) == F.lit(v))
    for k, v in (ne or {}).items():
        cond = cond & (F.col(k) != F.lit(v))
    for k, v in (re_ or {}).items():
        cond = cond & matches(F.col(k), v)
    for k, v in (nre or {}).items():
        cond = cond & ~matches(F.col(k), v)
    return cond
