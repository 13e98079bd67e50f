"""Relational building blocks that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with costly columns that are worked out once a row: filters and expressions above would repeat those of a projection, but stop at a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`; a grouped maximum, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def distribution(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows for each value."""
    return df.groupBy(col).agg(F.count("*").alias(name))


def pending(candidates: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that aren't done yet."""
    return candidates.join(done.select(*key).distinct(), key, "left_anti")


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def column_top(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
