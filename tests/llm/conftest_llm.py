"""Helpers of the tests in this folder."""

import pandas as pd


def lower(t: str) -> str:
    """A-Z to lower case, nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows(df, cols=None):
    """Rows as sorted tuples, for Spark and for pandas frames."""
    p = df.toPandas() if hasattr(df, "toPandas") else df
    cols = cols or sorted(p.columns)

    def fix(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) and not float(v).is_integer() else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(fix(v) for v in r) for r in p[cols].astype(object).values.tolist()), key=repr)
