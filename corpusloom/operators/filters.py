"""Filter dictionaries as column predicates.

``{"label": 3}``, ``{"page": {"$gte": 2, "$lte": 5}}``, ``{"$or": [...]}`` and, on the content,
``{"$contains": "text"}``. Names are columns or, failing that, entries of a metadata map.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import InvalidQueryError

_OPS = {
    "$eq": lambda c, v: c == F.lit(v), "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v), "$gte": lambda c, v: c >= F.lit(v), "$lt": lambda c, v: c < F.lit(v), "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def _column(df: DataFrame, name: str, map_col: str) -> Column:
    if name in df.columns:
        return F.col(name)
    if map_col in df.columns:
        return F.element_at(F.col(map_col), name)
    raise InvalidQueryError(f"no column or metadata {name}")


def predicate(df: DataFrame, where: dict | None, map_col: str = "metadata") -> Column:
    parts = []
    for name, want in (where or {}).items():
        if name in ("$and", "$or"):
            parts.append(reduce(and_ if name == "$and" else or_, [predicate(df, w, map_col) for w in want]))
            continue
        c = _column(df, name, map_col)
        if not isinstance(want, dict):
            want = {"$eq": want}
        for op, value in want.items():
            if op not in _OPS:
                raise InvalidQueryError(f"no operator {op}")
            parts.append(_OPS[op](c, value))
    return reduce(and_, parts) if parts else F.lit(True)


def content_predicate(where_document: dict | None, content: str = "content") -> Column:
    parts = []
    for op, value in (where_document or {}).items():
        if op == "$contains":
            parts.append(F.col(content).contains(value))
        elif op == "$not_contains":
            parts.append(~F.col(content).contains(value))
        else:
            raise InvalidQueryError(f"no operator {op}")
    return reduce(and_, parts) if parts else F.lit(True)


def parse_filter(text: str) -> dict:
    """``key=value`` pairs joined by commas; whole numbers become numbers."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = part.partition("=")
        if not eq or not key.strip():
            raise InvalidQueryError(f"not a key=value pair: {part}")
        value = value.strip()
        out[key.strip()] = int(value) if value.lstrip("-").isdigit() else value
    return out
