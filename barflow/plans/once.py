"""Evaluating a costly expression once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it: a lambda's variable is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column; a filter on it is applied to its result, where one on a plain column would be pushed below and evaluate it again."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
