"""Removal of duplicate rows and of rows with nulls, each with a one-row report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted


def _report(before: Column, after: Column) -> list[Column]:
    share = F.when(before > 0, (before - after) / before).otherwise(0.0)
    return [
        before.alias("before"),
        after.alias("after"),
        (before - after).alias("removed"),
        F.round(share, 4).alias("removed_share"),
    ]


def drop_duplicates_report(
    df: DataFrame, names: Sequence[str] | None = None, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with the first of each group of copies, and the report.

    With a ``key`` the copy of least key stays, a NULL key coming last; without one, any. Copies collapse before
    the shuffle, so a hot group costs one row per map task.
    """
    names = list(names or [c for c in df.columns if c != key])
    by = [F.col(quoted(c)) for c in names]
    order = F.lit(0) if key is None else F.struct(F.col(quoted(key)).isNull(), F.col(quoted(key)))
    row = F.min_by(F.struct(*(F.col(quoted(c)) for c in df.columns)), order)
    grouped = df.groupBy(*(c.alias(f"__by{i}") for i, c in enumerate(by))).agg(
        row.alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    clean = grouped.select("__row.*")
    counted = grouped.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("a"))
    return clean, counted.select(*_report(F.col("b"), F.col("a")))


def is_missing(name: str, null_tokens: Sequence[str] = ()) -> Column:
    col = F.col(quoted(name))
    if not null_tokens:
        return col.isNull()
    return col.isNull() | F.trim(col.cast("string")).isin(*null_tokens)


def drop_nulls_report(
    df: DataFrame, names: Sequence[str] | None = None, null_tokens: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Rows without a missing value, and the report; ``null_tokens`` are texts that mean NULL."""
    missing = F.lit(False)
    for c in names or df.columns:
        missing = missing | is_missing(c, null_tokens)
    counted = df.select(missing.cast("int").alias("m")).agg(
        F.count(F.lit(1)).alias("b"), F.coalesce(F.sum(1 - F.col("m")), F.lit(0)).alias("a")
    )
    return df.where(~missing), counted.select(*_report(F.col("b"), F.col("a")))


def removal_shares(duplicates: DataFrame, nulls: DataFrame) -> DataFrame:
    """Both reports as rows ``(reason, before, after, removed, removed_share)``."""
    return duplicates.select(F.lit("duplicates").alias("reason"), "*").unionByName(
        nulls.select(F.lit("nulls").alias("reason"), "*")
    )
