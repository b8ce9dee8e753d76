"""Projections, filters, row numbers, set operations and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted, typed
from kveil.session import cut_lineage
from kveil.sources.config import Attribute, Roles

# monotonically_increasing_id puts the partition above 33 bits of position inside it
POSITION_BITS = 33
# the number of a row among its copies, and how many of those are written out of one array
COPY = "__copy"
COPY_RUN = 4096


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def select_named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*cols(names))


def select_typed(df: DataFrame, attrs: Sequence[Attribute], keep: Sequence[str] = ()) -> DataFrame:
    """The chosen columns as their job types, in order; ``keep`` columns come first, unchanged."""
    return df.select(*cols(keep), *[typed(df, a.name, a.data_type) for a in attrs])


def select_roles(df: DataFrame, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """Quasi-identifiers and sensitive columns, typed; identifiers are left behind."""
    return select_typed(df, roles.selected, keep)


def suppress_identifiers(df: DataFrame, roles: Roles) -> DataFrame:
    return df.drop(*[a.name for a in roles.identifiers])


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cap(df: DataFrame, n: int | None, key: str = "id") -> DataFrame:
    """Rows whose key is at most ``n``; all rows without a cap."""
    return df if n is None else df.where(F.col(quoted(key)) <= n)


def by_key(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(quoted(key)) == value)


def cluster_rows(df: DataFrame, name: str, cluster: str = "Cluster") -> DataFrame:
    return df.where(F.col(quoted(cluster)) == name)


def equals_ignoring_case(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.lower(F.col(quoted(col))) == value.lower())


def starts_with(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(quoted(col)).startswith(prefix))


def all_columns(df: DataFrame) -> list[str]:
    return list(df.columns)


def predictor_columns(df: DataFrame) -> list[str]:
    """Text and integer columns, and doubles that are not encoder indices."""
    return [
        name
        for name, kind in df.dtypes
        if kind in ("string", "int") or (kind == "double" and "Index" not in name)
    ]


def copies_apart(df: DataFrame) -> DataFrame:
    """``df`` with a column ``__copy`` that numbers equal rows from 0: copies are counted, then written out again.

    Counting meets copies before the shuffle. The numbers come in runs, so no array grows with a group.
    """
    counted = df.groupBy(*cols(df.columns)).agg(F.count(F.lit(1)).alias("__copies"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__copies") - 1, F.lit(COPY_RUN).cast("long"))))
    first = F.col("__run") * COPY_RUN
    last = F.least(first + COPY_RUN, F.col("__copies")) - 1
    return counted.withColumn("__run", runs).withColumn(COPY, F.explode(F.sequence(first, last))).drop("__copies", "__run")


def with_dense_id(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    id_col: str = "id",
    unique: bool = False,
    order: str = "content",
) -> DataFrame:
    """Adds a dense 64-bit row number from 1 as the first column, without a one-task window.

    ``order="content"`` numbers by ``keys``, ties by the remaining columns, so the result does not
    depend on how the input is partitioned. Rows are range-partitioned and sorted, and the
    position of each row is frozen by writing the table out; a prefix sum over the per-partition counts
    then turns positions into numbers. Equal rows are interchangeable, so the range key ends in
    a spreading column and a hot group of copies is cut over many partitions. ``unique=True``
    promises that the keys alone tell rows apart.

    ``order="input"`` keeps the order of the input partitions and moves no rows.
    """
    if id_col in df.columns:
        raise ValueError(f"the table has a column {id_col} already")
    place = "__place"
    if order == "input":
        placed = df
    else:
        names = list(keys if keys is not None else df.columns)
        placed = df
        if not unique:
            names += [c for c in df.columns if c not in names] + [COPY]
            placed = copies_apart(df)
        placed = placed.repartitionByRange(*cols(names)).sortWithinPartitions(*cols(names))
    placed = cut_lineage(placed.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, POSITION_BITS)
    position = F.col(place).bitwiseAND((1 << POSITION_BITS) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    offsets, seen = [], 0
    for r in counts:  # one entry per partition
        offsets.append((r.part, seen))
        seen += r.n
    table = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(table), "__part")
        .select((F.col("__offset") + position + 1).alias(id_col), *cols(df.columns))
    )


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def except_rows(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of ``a`` not in ``b``: distinct whole rows, or all rows whose key is not in ``b``."""
    return a.subtract(b) if key is None else a.join(b, key, "left_anti")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def one_random_row(df: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """The row whose key hashes least: a repeatable draw without a full sort."""
    return df.orderBy(F.xxhash64(F.col(quoted(key)), F.lit(seed)), quoted(key)).limit(1)


def sort_by_key(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(quoted(key))


def first_rows(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)
