"""Greedy k-member clustering, block-parallel.

The published greedy method compares every free record with the open cluster, which is quadratic.
Here rows are first put in an order that keeps alike rows together, numbered, and cut into blocks of
``block_rows`` to twice that many neighbours; the method runs exactly within each block. Blocks
depend on the data only, not on its partitioning, and have equal size whatever the skew: a hot
group of equal rows simply fills many blocks. The worst clusters of neighbouring blocks, mostly what was left
over of many kinds of rows, are then taken apart and clustered once more together.

Only keys and quasi-identifiers travel; the other columns are joined to the result by key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.functions import blocks
from kveil.functions.casting import quoted
from kveil.operators.cohorts import SIZE, domain_of, name_of
from kveil.operators.hierarchy import MAX_DEPTH, Hierarchy, lookup
from kveil.operators.project import with_dense_id
from kveil.session import cut_lineage
from kveil.sources.config import Roles

# workers need not have this package installed: the block functions travel with the task
cloudpickle.register_pickle_by_value(blocks)

# blocks that one Python call works on side by side
SIDE_BY_SIDE = 16
# rows drawn by key hash to learn how values rank, and points kept per column
RANK_ROWS = 20_000
RANK_POINTS = 2_000
RANK_SEED = 17


def rank_values(df: DataFrame, roles: Roles, hierarchy: Hierarchy) -> DataFrame:
    """``df`` with a double per quasi-identifier whose order is that of its values: ``__r<i>``.

    Categories are ordered along their tree, those without one by a hash.
    """
    out = df
    for i, a in enumerate(roles.quasi):
        name, col = f"__r{i}", F.col(quoted(a.name))
        if a.is_numeric:
            out = out.withColumn(name, col.cast("double"))
        elif hierarchy.has(a.name):
            out = lookup(out, a.name, hierarchy.closure, a.name, {name: F.col("pre").cast("double")})
        else:
            out = out.withColumn(name, F.pmod(F.xxhash64(col), F.lit(1 << 20)).cast("double"))
    return out


def rank_curves(valued: DataFrame, n: int, columns: int, key: str) -> list[tuple[list[float], list[float]]]:
    """Per column, values and their ranks from 0 to 1, from about ``RANK_ROWS`` rows of least key hash.

    The draw depends on keys alone, so the curves do not depend on how the table is partitioned.
    """
    names = [f"__r{i}" for i in range(columns)]
    if n > RANK_ROWS:
        share = int(RANK_ROWS / n * (1 << 32))
        valued = valued.where(F.pmod(F.xxhash64(F.col(quoted(key)), F.lit(RANK_SEED)), F.lit(1 << 32)) < share)
    drawn = valued.select(*names).toArrow()
    curves = []
    for name in names:
        values = drawn[name].drop_null().to_numpy()
        if not len(values):
            curves.append(([0.0], [0.0]))
            continue
        value, count = np.unique(values, return_counts=True)
        rank = (np.cumsum(count) - count / 2) / len(values)
        if len(value) > RANK_POINTS:
            at = np.unique(np.linspace(0, len(value) - 1, RANK_POINTS).astype(int))
            value, rank = value[at], rank[at]
        curves.append((value.tolist(), rank.tolist()))
    return curves


def z_order(curves: list[tuple[list[float], list[float]]]) -> Column:
    """A 62-bit key of the columns ``__r<i>``: their ranks' bits interleaved, missing values last.

    Placing by rank keeps an outlier from folding a column into a few places.
    """
    bits = 62 // len(curves)

    @F.pandas_udf("long")
    def key_of(*columns: pd.Series) -> pd.Series:
        places = []
        for column, (value, rank) in zip(columns, curves):
            v = column.to_numpy(dtype=float, na_value=np.nan)
            place = np.interp(v, value, rank) * float(1 << bits)
            place = np.where(np.isnan(v), (1 << bits) - 1, np.minimum(place, (1 << bits) - 1))
            places.append(place.astype(np.int64))
        key = np.zeros(len(places[0]), dtype=np.int64)
        for bit in range(bits - 1, -1, -1):
            for place in places:
                key = (key << 1) | ((place >> bit) & 1)
        return pd.Series(key)

    return key_of(*(F.col(f"__r{i}") for i in range(len(curves))))


def level_worths(hierarchy: Hierarchy, names: list[str]) -> dict[tuple[str, int], float]:
    """By attribute and depth, how much of the loss of a whole tree telling nodes of that depth apart saves."""
    if not names:
        return {}
    above = F.get("anc_height", F.col("depth") - 2)
    drop = (above - F.col("height")) / F.greatest("tree_height", F.lit(1))
    deep = hierarchy.closure.where(F.col("attr").isin(names) & (F.col("depth") > 1))
    return {(r.attr, r.depth): r.worth for r in deep.groupBy("attr", "depth").agg(F.avg(drop).alias("worth")).collect()}


def digits_by_worth(
    roles: Roles, hierarchy: Hierarchy, worths: dict, path: Callable[[str], Column], text: Callable[[str], Column]
) -> list[Column]:
    """Columns to sort rows by, so that alike ones are neighbours; ``__z`` holds the ranks of their numbers.

    Every level of a tree is a digit that saves its share of the loss, and the j-th bit of a number's rank saves
    2^-j. Digits are sorted by what they save; of equal ones levels come first, because a value that is cut in
    two leaves leftovers in both halves. ``path`` gives a category's node numbers from the root down, ``text`` what
    stands for a value in no tree.
    """
    found = []  # (-worth, numbers last, place among its kind, column)
    for i, q in enumerate(roles.category_quasi):
        stray = -1 - F.pmod(F.xxhash64(text(q)), F.lit(1 << 30)).cast("int")
        if not hierarchy.has(q):
            found.append((-1.0, 0, (i, 0), stray))
        for depth in range(2, hierarchy.depth(q) + 1):
            node = F.when(path(q).isNull(), stray).otherwise(F.get(path(q), F.lit(depth - 1)))
            found.append((-worths.get((q, depth), 0.0), 0, (i, depth), node))
    numbers = len(roles.numeric_quasi)
    if numbers:
        bits, first = 62 // numbers, 1
        cuts = [d[0] for d in found]
        while first <= bits:  # neighbouring bits with no level between them are one digit
            last = first
            while last < bits and not any(-(2.0**-last) < c <= -(2.0 ** -(last + 1)) for c in cuts):
                last += 1
            piece = F.shiftright("__z", numbers * (bits - last))
            piece = piece.bitwiseAND(F.lit((1 << numbers * (last - first + 1)) - 1))
            found.append((-(2.0**-first), 1, (first, 0), piece))
            first = last + 1
    return [d[3] for d in sorted(found, key=lambda d: d[:3])]


def order_by_worth(df: DataFrame, roles: Roles, hierarchy: Hierarchy, n: int, key: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns ``__o<i>`` of ``digits_by_worth``, and their names."""
    numbers, trees = list(roles.numeric_quasi), [q for q in roles.category_quasi if hierarchy.has(q)]
    valued = df.withColumns({f"__r{i}": F.col(quoted(q)).cast("double") for i, q in enumerate(numbers)})
    paths = {q: f"__t{i}" for i, q in enumerate(trees)}
    for q, name in paths.items():
        valued = lookup(valued, q, hierarchy.closure, q, {name: F.col("anc_pre")})
    if numbers:
        valued = valued.withColumn("__z", z_order(rank_curves(valued, n, len(numbers), key)))
    worths = level_worths(hierarchy, trees)
    digits = digits_by_worth(roles, hierarchy, worths, lambda q: F.col(paths[q]), lambda q: F.col(quoted(q)))
    names = [f"__o{i}" for i in range(len(digits))]
    out = valued.select(*[F.col(quoted(c)) for c in df.columns], *[d.alias(x) for d, x in zip(digits, names)])
    return out, names


class BlockPlan:
    """Sizes and numbers of ``n`` rows cut into equal blocks, the first ``rem`` one row longer."""

    def __init__(self, n: int, k: int, block_rows: int):
        self.n, self.k = n, k
        self.count = max(1, n // block_rows)
        self.base, self.rem = divmod(n, self.count)

    def block(self, position: Column) -> Column:
        """Block of a row by its position from 0."""
        long_rows = self.rem * (self.base + 1)

        def cut(p: Column, size: int) -> Column:
            return F.call_function("div", p, F.lit(size).cast("long"))

        return F.when(position < long_rows, cut(position, self.base + 1)).otherwise(
            F.lit(self.rem).cast("long") + cut(position - F.lit(long_rows).cast("long"), self.base)
        )


def greedy_k_member(
    df: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    k: int,
    key: str = "id",
    block_rows: int = 1000,
    seed: int = 0,
    check_keys: bool = False,
    exchange: float = 0.3,
) -> DataFrame:
    """``df`` with ``Cluster`` and ``Info``: clusters of at least k rows, alike in their quasi-identifiers.

    Per block: the first seed is the row whose key hashes least; a cluster opens with the free row
    furthest from the row added last (``Centroid``) and takes the row of least information loss
    until it has k rows (``Member``); when fewer than k rows are free, each joins the cluster whose
    loss rises least (``Remainder``). Losses are compared to nine places and ties go to the least key.

    The block rule is part of the definition at every size: ``n`` rows make ``n // block_rows``
    blocks, at least one, of equal size to within a row, in the order of ``order_by_worth``. One block is the
    unrestricted greedy method. The cost is about ``n * block_rows`` comparisons; ``block_rows`` must not be below ``k``.

    Then rows cross the borders: of every block the ``exchange`` share of clusters that lose most, among those
    of k rows, goes into a pool with those of its neighbours, about one block's rows in all, which the method clusters
    again. A pool keeps the new clusters, under the old names, if they lose less. With an ``exchange`` of 0, or
    one block, rows of different blocks never share a cluster.

    ``key`` must tell rows apart: the result is joined to ``df`` by it, so ``df`` is computed twice. Its key and
    quasi-identifiers are written out once for all passes that need them.
    """
    named = assign_clusters(df, roles, hierarchy, k, key, block_rows, seed, check_keys, exchange)
    return df.join(named, F.col(quoted(key)).eqNullSafe(F.col("__key"))).drop("__key")


def assign_clusters(
    df: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    k: int,
    key: str = "id",
    block_rows: int = 1000,
    seed: int = 0,
    check_keys: bool = False,
    exchange: float = 0.3,
    profiled: bool = False,
) -> DataFrame:
    """(``__key``, Cluster, Info) of ``greedy_k_member``; ``profiled`` adds the fields of ``cohorts.profiles``.

    The clusters are whole where they are made, so their bounds cost no further pass.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if block_rows < k:
        raise ValueError(f"block_rows {block_rows} is below k {k}")
    if not 1 <= len(roles.quasi) <= 62:
        raise ValueError(f"needs 1 to 62 quasi-identifiers, got {len(roles.quasi)}")
    if not 0 <= exchange <= 1:
        raise ValueError(f"exchange is a share, got {exchange}")
    if check_keys:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(quoted(key)).alias("d")).first()
        if r.n != r.d:
            raise ValueError(f"{key} is not unique: {r.d} values in {r.n} rows")
    carried = list(dict.fromkeys([key, *(a.name for a in roles.quasi)]))
    # read several times below, and often a join over few input files: computed once, and dealt out to all workers
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = cut_lineage(df.select(*map(quoted, carried)).repartition(tasks, quoted(key)))
    domain = domain_of(narrow, roles)
    n = narrow.count()
    if n < k:
        raise ValueError(f"{n} rows cannot form a cluster of {k}")
    placed, order = order_by_worth(narrow, roles, hierarchy, n, key)
    placed = cut_lineage(placed)  # sampled for its ranges, then dealt out
    ranked = with_dense_id(placed, [*order, key], id_col="__rank", unique=True).drop(*order)
    plan = BlockPlan(n, k, block_rows)

    # any column name survives the trip to Arrow under a plain one
    plain = {c: f"__p{i}" for i, c in enumerate(carried)}
    kinds = [plain[q] for q in roles.category_quasi]
    shape = T.StructType([T.StructField(plain[c], narrow.schema[c].dataType) for c in carried])
    shape = shape.add("__block", "long").add("__no", "long").add("__kind", "integer")
    fields = bound_fields(narrow, roles) if profiled else {}
    for name, (_, data_type) in fields.items():
        shape = shape.add(name, data_type)
    bounds = ([plain[q] for q in roles.numeric_quasi], kinds) if profiled else None

    def clustered(rows: DataFrame, by: str, groups: int, work, schema: T.StructType) -> DataFrame:
        rows = rows.withColumn("__hash", F.xxhash64(F.col(quoted(key)), F.lit(seed)))
        return in_groups(rows, roles, hierarchy, domain, by, groups, plain).groupBy("__group").applyInArrow(work, schema)

    work = blocks.block_worker(
        plan.base, plan.rem, k, list(plain.values()), plain[key], len(roles.numeric_quasi), kinds, exchange, bounds
    )
    first = ranked.withColumn("__block", plan.block(F.col("__rank") - 1)).drop("__rank")
    wide = T.StructType(list(shape.fields)).add("__again", "boolean").add("__loss", "double")
    first = clustered(first, "__block", plan.count, work, wide)
    if exchange and plan.count > 1:
        first = cut_lineage(first)
        back = {p: c for c, p in plain.items()}
        pool = max(2, round(1 / exchange))
        again = first.where("__again").drop(*fields).withColumn("__pool", F.call_function("div", F.col("__block"), F.lit(pool).cast("long")))
        work = blocks.exchange_worker(k, list(plain.values()), plain[key], len(roles.numeric_quasi), kinds, bounds)
        second = clustered(again.withColumnsRenamed(back), "__pool", -(-plan.count // pool), work, shape)
        first = first.where("NOT __again").select(second.columns).unionByName(second)
    info = F.array(*[F.lit(x) for x in (blocks.CENTROID, blocks.MEMBER, blocks.REMAINDER)])
    return first.select(
        F.col(plain[key]).alias("__key"),
        F.concat(F.lit("Cluster "), F.col("__no").cast("string")).alias("Cluster"),
        F.get(info, F.col("__kind")).alias("Info"),
        *[F.col(quoted(name)).alias(field) for name, (field, _) in fields.items()],
    )


def bound_fields(df: DataFrame, roles: Roles) -> dict[str, tuple[str, T.DataType]]:
    """What the kernel calls the fields of a profile: their names in ``cohorts`` and their types."""
    whole, node = T.LongType(), T.IntegerType()
    out = {"__no_count": (SIZE, whole)}
    for i, q in enumerate(roles.numeric_quasi):
        own = df.schema[q].dataType
        for made, field, kind in (("min", "lo", own), ("max", "hi", own), ("count", "nn", whole)):
            out[f"__n{i}_{made}"] = (name_of(q, field), kind)
    for i, q in enumerate(roles.category_quasi):
        own = df.schema[q].dataType
        for made, field, kind in (("min", "lo", node), ("max", "hi", node), ("count", "mapped", whole)):
            out[f"__p{i}_{made}"] = (name_of(q, field), kind)
        out[f"__c{i}_count"] = (name_of(q, "nn"), whole)
        out |= {f"__u{i}_min": (name_of(q, "ulo"), own), f"__u{i}_max": (name_of(q, "uhi"), own)}
    return out


def in_groups(
    rows: DataFrame, roles: Roles, hierarchy: Hierarchy, domain: dict, by: str, count: int, plain: dict[str, str]
) -> DataFrame:
    """Encoded rows with ``__group``, a few of ``count`` neighbouring blocks or pools ``by``, dealt out by it."""
    spark = rows.sparkSession
    workers = 4 * spark.sparkContext.defaultParallelism
    side = max(1, min(SIDE_BY_SIDE, count // workers))
    tasks = min(-(-count // side), max(workers, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("__group", F.call_function("div", F.col(by), F.lit(side).cast("long")))
    if hierarchy.small:  # node paths join by broadcast, so they need not travel through the shuffle
        return encode(rows.repartition(tasks, "__group"), roles, hierarchy, domain).withColumnsRenamed(plain)
    return encode(rows, roles, hierarchy, domain).repartition(tasks, "__group").withColumnsRenamed(plain)


def encode(df: DataFrame, roles: Roles, hierarchy: Hierarchy, domain: dict) -> DataFrame:
    """Numbers scaled by their domain; per category the value's node and the nodes above it.

    ``__c<i>_lo/hi/h`` are first and last preorder number and height of the nodes below the root on
    the way to the value, ending in the value alone with height 0.
    """
    out = df
    for i, q in enumerate(roles.numeric_quasi):
        lo, hi = domain[q]
        width = 0.0 if lo is None else float(hi) - float(lo)
        v = (F.col(quoted(q)).cast("double") - F.lit(float(lo or 0))) / F.lit(width if width > 0 else 1.0)
        out = out.withColumn(f"__n{i}", v)
    for i, q in enumerate(roles.category_quasi):
        if not hierarchy.has(q):
            continue

        def chain(field: str, own: Column) -> Column:
            below = F.slice(field, 2, MAX_DEPTH)
            alone = (F.col("height") > 0) | (F.col("depth") == 1)
            return F.concat(below, F.when(alone, F.array(own)).otherwise(F.array().cast("array<int>")))

        scale = float(max(hierarchy.height[q], 1))
        fields = {
            f"__c{i}_pre": F.col("pre"),
            f"__c{i}_lo": chain("anc_pre", F.col("pre")),
            f"__c{i}_hi": chain("anc_last", F.col("pre")),
            f"__c{i}_h": F.transform(chain("anc_height", F.lit(0)), lambda x: x / F.lit(scale)),
        }
        out = lookup(out, q, hierarchy.closure, q, fields)
    return out
