"""Deterministic pseudo-random ordering.

Every random choice (structures, folds, label noise, shuffles) is an order by the
hex md5 of ``seed|key|...``.  The same text hashes identically in Spark SQL and in
DuckDB, so each choice can be recomputed by an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(*parts) -> Column:
    """md5 hex of the parts joined with '|'. Ints/str literals or Columns."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def h_sql(*parts: str) -> str:
    """The same key as DuckDB / Spark SQL text (parts are SQL expressions)."""
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def h_int(*parts) -> Column:
    """A non-negative integer drawn from the md5 key (first 7 hex digits)."""
    return F.conv(F.substring(h(*parts), 1, 7), 16, 10).cast("long")
