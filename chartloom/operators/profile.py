"""Profiling aggregates: shares, bands, top lists, lengths and coverage, each in one pass over its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def group_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n, pct): how often each value of each column occurs, nulls too. The table is read once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("field"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / total, 4))


def band_counts(df: DataFrame, band: Column) -> DataFrame:
    """(band, n)."""
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: n, and for each name how many rows meet its condition."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def top_groups(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, n): the ``n`` most frequent combinations; ties go by the keys, nulls first."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *[F.asc_nulls_first(k) for k in keys]).limit(n)


def rounded_means(df: DataFrame, keys: list[str], value: str, top: int) -> DataFrame:
    """(keys, n, mean): rounded to two places, of the ``top`` most frequent groups."""
    agg = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"))
    return agg.orderBy(F.desc("n"), *[F.asc_nulls_first(k) for k in keys]).limit(top)


def text_lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, mean_length, min_length, max_length)."""
    length = F.length(text).cast("long")
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(length)).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))


def frequent_groups(df: DataFrame, key: str, time: str, rows: int, times: int) -> DataFrame:
    """(key, n_rows, n_times) of the keys with enough rows and distinct times."""
    agg = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(time).alias("n_times"))
    return agg.where((F.col("n_rows") >= rows) & (F.col("n_times") >= times))


def coverage(df: DataFrame, total: str, conditions: dict[str, Column]) -> DataFrame:
    """(part, n_keys, n_covered, ratio): distinct keys, and those with a row that meets the condition."""
    keys = df.groupBy(total).agg(*[F.max(c.cast("int")).alias(name) for name, c in conditions.items()])
    one = keys.agg(F.count(total).alias("n_keys"), *[F.sum(name).cast("long").alias(name) for name in conditions])
    return one.select("n_keys", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(c, F.lit(0)).alias("n_covered")) for c in conditions])).alias("p")).select("p.part", "n_keys", "p.n_covered", F.round(F.try_divide("p.n_covered", "n_keys"), 6).alias("ratio"))
