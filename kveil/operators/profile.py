"""Counts, bounds, summaries, distinct values and token counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.functions.casting import quoted


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def min_max(df: DataFrame, names: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """``<col>_min`` and ``<col>_max`` of the numeric columns, for the table or per cluster."""
    names = [c for c in (names or numeric_columns(df)) if c != by]
    aggs = [f(quoted(c)).alias(f"{c}_{s}") for c in names for s, f in (("min", F.min), ("max", F.max))]
    return df.agg(*aggs) if by is None else df.groupBy(quoted(by)).agg(*aggs)


def cluster_sizes(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(quoted(cluster)).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, names: Sequence[str], by: str = "Cluster") -> DataFrame:
    """``<col>_ndv``: distinct non-null values of each column per cluster."""
    return df.groupBy(quoted(by)).agg(*[F.count_distinct(quoted(c)).alias(f"{c}_ndv") for c in names])


def top_groups(df: DataFrame, group: str, counted: str, n: int = 10) -> DataFrame:
    """The ``n`` groups with most non-null values of ``counted``; ties by group."""
    counts = df.groupBy(quoted(group)).agg(F.count(quoted(counted)).alias("n"))
    return counts.orderBy(F.desc("n"), quoted(group)).limit(n)


def describe(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.describe(*(names or df.columns))


def summary_long(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, mean, stddev (numeric columns only), min and max as text."""
    names = list(names or df.columns)
    numeric = set(numeric_columns(df))
    aggs = []
    for i, c in enumerate(names):
        col = F.col(quoted(c))
        value = col.cast("double") if c in numeric else F.lit(None).cast("double")
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.avg(value).alias(f"a{i}"),
            F.stddev_samp(value).alias(f"s{i}"),
            F.min(col).cast("string").alias(f"l{i}"),
            F.max(col).cast("string").alias(f"h{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("count"),
            F.col(f"a{i}").alias("mean"),
            F.col(f"s{i}").alias("stddev"),
            F.col(f"l{i}").alias("min"),
            F.col(f"h{i}").alias("max"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def median_approx(df: DataFrame, col: str, accuracy: int = 10_000) -> DataFrame:
    return df.agg(F.percentile_approx(quoted(col), 0.5, accuracy).alias("median"))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value; ties go to the least."""
    counts = df.groupBy(F.col(quoted(col)).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "mode").limit(1)


def tokens(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per token; empty tokens at the end of a text do not count."""
    literal = re.escape(sep)
    text = F.col(quoted(col))
    body = F.regexp_replace(text, f"({literal})+$", "")
    kept = df.where((text == "") | (body != ""))
    return kept.select(F.explode(F.split(body, literal)).alias("token"))


def token_counts(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    return tokens(df, col, sep).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def token_stats(counts: DataFrame) -> DataFrame:
    """Number of tokens, the greatest (count, token) pair, and the sum of counts."""
    top = F.max(F.struct("n", "token"))
    return counts.agg(
        F.count(F.lit(1)).alias("tokens"),
        top["n"].alias("max_n"),
        top["token"].alias("max_token"),
        F.sum("n").alias("total"),
    )


def rarest_tokens(counts: DataFrame, n: int = 3) -> DataFrame:
    return counts.orderBy("n", "token").limit(n)


def partition_census(df: DataFrame) -> DataFrame:
    """Rows per partition, empty partitions too."""
    slots = df.rdd.getNumPartitions()
    found = df.groupBy(F.spark_partition_id().alias("partition_number")).agg(
        F.count(F.lit(1)).alias("number_of_records")
    )
    every = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("partition_number"))
    return every.join(found, "partition_number", "full").select(
        "partition_number", F.coalesce("number_of_records", F.lit(0)).alias("number_of_records")
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(quoted(col)).distinct()


def distinct_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of several columns from one scan."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in names
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
