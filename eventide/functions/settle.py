"""Expressions that are worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are worked out once a row. A filter or a later column that uses them
    isn't rewritten in terms of their expressions: a one-row generator stands between."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_settled")
    return df.select("*", one).select(*[c for c in df.columns if c not in cols], *[F.col(f"_settled.{n}") for n in cols])


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of values that are worked out once, however often ``f`` reads them, even
    inside its own lambdas."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), f), F.lit(0))
