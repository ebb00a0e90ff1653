"""Set operations, by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_sources(*dfs).distinct()


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def intersect_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))
