"""Comparing results and events, with tolerances, in DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same(a: Column, b: Column, dtype: T.DataType, tolerance: float) -> Column:
    if isinstance(dtype, T.NumericType):
        close = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
        return a.eqNullSafe(b) | F.coalesce(close, F.lit(False))
    return a.eqNullSafe(b)


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9, tolerances: dict[str, float] | None = None) -> DataFrame:
    """Rows (keys, column, left_value, right_value) that differ; rows of one side only have column '_row'."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.select(*keys, *(F.col(f"`{c}`").alias(f"a_{i}") for i, c in enumerate(shared)), F.lit(1).alias("in_a"))
    b = right.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(F.col(f"`{c}`").alias(f"b_{i}") for i, c in enumerate(shared)), F.lit(1).alias("in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    both = a.join(b, on, "full_outer")
    found = [F.struct(F.lit("_row").alias("column"), F.col("in_a").cast("string").alias("left_value"), F.col("in_b").cast("string").alias("right_value"), (F.col("in_a").isNull() | F.col("in_b").isNull()).alias("bad"))]
    there = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for i, c in enumerate(shared):
        x, y = F.col(f"a_{i}"), F.col(f"b_{i}")
        bad = there & ~same(x, y, left.schema[c].dataType, (tolerances or {}).get(c, tolerance))
        found.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"), bad.alias("bad")))
    ids = [F.coalesce(F.col(k), F.col(f"k_{k}")).alias(k) for k in keys]
    rows = both.select(*ids, F.explode(F.array(*found)).alias("d")).where("d.bad")
    return rows.select(*keys, "d.column", "d.left_value", "d.right_value")


def equal(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> bool:
    return sorted(left.columns) == sorted(right.columns) and differences(left, right, keys, tolerance).isEmpty()
