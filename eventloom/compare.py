"""Differences between two event tables: absent columns and rows, and values beyond a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same(a: Column, b: Column, kind: T.DataType, atol: float, rtol: float) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        x, y = a.cast("double"), b.cast("double")
        both_nan = F.isnan(x) & F.isnan(y)
        return both_nan | (x == y) | (~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= atol + rtol * F.abs(y)))
    if isinstance(kind, T.ArrayType):
        each = F.zip_with(a, b, lambda x, y: F.coalesce(_same(x, y, kind.elementType, atol, rtol), x.isNull() & y.isNull()))
        return (F.size(a) == F.size(b)) & F.forall(each, lambda z: z)
    return a == b


def compare(ours: DataFrame, reference: DataFrame, key: str, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """(column, missing, extra, differing): one row a column that either table has, rows matched by a full join on key.

    Integers and flags must be equal, floats within atol + rtol * |reference|, arrays in length and every element.
    """
    mine, theirs = {f.name: f.dataType for f in ours.schema}, {f.name: f.dataType for f in reference.schema}
    a = ours.select(F.col(key).alias("__k"), *[F.col(c).alias(f"a_{c}") for c in mine], F.lit(True).alias("__a"))
    b = reference.select(F.col(key).alias("__j"), *[F.col(c).alias(f"b_{c}") for c in theirs], F.lit(True).alias("__b"))
    both = a.join(b, F.col("__k") == F.col("__j"), "full")
    sums, rows = [F.sum(F.col("__a").isNull().cast("long")).alias("missing"), F.sum(F.col("__b").isNull().cast("long")).alias("extra")], []
    for c in sorted(set(mine) & set(theirs)):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = F.coalesce(_same(x, y, theirs[c], atol, rtol), x.isNull() & y.isNull())
        sums.append(F.sum((F.col("__a") & F.col("__b") & ~same).cast("long")).alias(f"d_{c}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit("both").alias("found"), F.col("missing"), F.col("extra"), F.col(f"d_{c}").alias("differing")))
    none = F.lit(None).cast("long")
    for c in sorted(set(mine) ^ set(theirs)):
        rows.append(F.struct(F.lit(c).alias("column"), F.lit("ours" if c in mine else "reference").alias("found"), F.col("missing"), F.col("extra"), none.alias("differing")))
    return both.agg(*sums).select(F.inline(F.array(*rows)))
