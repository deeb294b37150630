"""Query registry: key -> Spark builder (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name`` with its oracle SQL (None = rows-only check)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = positive_zero_sql(sql)
        return fn

    return deco


def _round(x: Column, places: int) -> Column:
    """``round(x, places)`` of a double. Spark rounds through a decimal object; where the scaled value is clearly nearer to one
    integer, that integer over the scale is the same double and needs none."""
    if not 0 <= places <= 9:
        return F.round(x, places)
    scaled = x * F.lit(10.0 ** places)
    clear = (F.abs(scaled) < F.lit(1e10)) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(1e-4))
    return F.when(clear, F.floor(scaled + F.lit(0.5)) / F.lit(10.0 ** places)).otherwise(F.round(x, places))


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` overrides places per column, ``None`` keeps
    the exact value) so engines agree on value hashes despite summation order."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and special.get(f.name, places) is not None:
            # + 0.0 turns a rounded -0.0 into 0.0 (both engines then print the same value)
            cols.append((_round(F.col(f.name).cast("double"), special.get(f.name, places)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def positive_zero_sql(text: str) -> str:
    """Wrap every ``round(...)`` of an oracle query as ``(round(...) + 0e0)`` so a rounded
    tiny negative compares equal to Spark's 0.0 instead of printing as -0.0."""
    out, i = [], 0
    low = text.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(text[i:])
                return "".join(out)
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if text[k] == "(":
                depth += 1
            elif text[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_sql(text[j + 6:k])
        out.append(text[i:j] + "(round(" + inner + ") + 0e0)")
        i = k + 1
