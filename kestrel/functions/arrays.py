"""Constant arrays inside Column expressions.

A fitted count model is small (its size follows from the domain and the structure,
not from the data), so scoring ships it inside the plan as one constant array and
looks cells up with ``element_at``: a narrow, codegen'd projection with no join and
no shuffle.  The array is written as a single string literal and cast, which
Catalyst constant-folds once on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest model (cells) that is embedded in the plan (8 bytes per cell).
MAX_LITERAL_CELLS = 4_000_000


def _fmt(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    return repr(float(v))


def const_doubles(values) -> Column:
    vals = list(values)
    if len(vals) > MAX_LITERAL_CELLS:
        raise ValueError(f"constant array of {len(vals)} cells exceeds {MAX_LITERAL_CELLS}")
    if not vals:
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(_fmt(v) for v in vals)), ",").cast("array<double>")


def const_ints(values) -> Column:
    vals = [str(int(v)) for v in values]
    if not vals:
        return F.array().cast("array<int>")
    return F.split(F.lit(",".join(vals)), ",").cast("array<int>")


def argmax_first(arr: Column) -> Column:
    """0-based position of the first maximum (G-1 / V-8 tie rule)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
