"""The best cluster of every row of a table, by a tree of boxes over the clusters.

Clusters lie in an order that keeps alike ones together and are cut into blocks of neighbours. A box holds the
bounds of a block: least and greatest value per column, least size, least own loss. From a box and the
bounds of a block of rows follows a lower bound on what any of those rows adds to any of those clusters, so
most blocks of clusters are never looked at. Boxes of boxes form a tree of a few levels; going down it is one
equi-join per level, from the few boxes at the top, and rows and clusters meet only in the blocks that are left.

What a row adds to a cluster of n rows is (n + 1) * joined - n * own with joined >= own in every
column, hence at least own; and it rises with n and with the distance of the row from the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kveil.functions import gains
from kveil.functions.casting import quoted
from kveil.functions.metrics import LossModel, shared_depth
from kveil.operators.cluster import digits_by_worth, level_worths, rank_curves, z_order
from kveil.operators.cohorts import PATH_FIELDS, SIZE, from_columns, name_of, scaled_heights
from kveil.operators.hierarchy import Hierarchy
from kveil.operators.project import with_dense_id
from kveil.session import cut_lineage
from kveil.sources.config import Roles

# workers need not have this package installed: these functions travel with the task
cloudpickle.register_pickle_by_value(gains)

SLICE = 256  # clusters of a block, and rows of a block
FANOUT = 16  # boxes under a box
TOP = 64  # boxes at the top, at most
HOME = 4  # blocks of least bound that every block of rows visits first
SLACK = 1e-6  # losses are compared to nine places, bounds are not rounded


def div(a: Column, by: int) -> Column:
    return F.call_function("div", a, F.lit(by).cast("long"))


@dataclass(frozen=True)
class Order:
    """The order of clusters and rows: what it takes to turn their middles into sort keys."""

    roles: Roles
    hierarchy: Hierarchy
    worths: dict
    curves: list

    def blocks(self, df: DataFrame, numbers: list[Column], text: str, ties: list[str]) -> DataFrame:
        """``df`` with ``block``: neighbours, at most SLICE in a block. Nodes are read from the ``anc_pre`` fields."""
        columns, placed = df.columns, df
        if numbers:
            placed = placed.withColumns({f"__r{i}": n.cast("double") for i, n in enumerate(numbers)})
            placed = placed.withColumn("__z", z_order(self.curves))
        digits = digits_by_worth(
            self.roles, self.hierarchy, self.worths, lambda q: from_columns(q, "anc_pre"), lambda q: from_columns(q, text)
        )
        names = [f"__o{i}" for i in range(len(digits))]
        placed = placed.select(*map(quoted, columns), *[d.alias(n) for d, n in zip(digits, names)])
        numbered = with_dense_id(placed, [*names, *ties], id_col="__rank", unique=True)
        return numbered.withColumn("block", div(F.col("__rank") - 1, SLICE)).drop("__rank", *names)


@dataclass(frozen=True)
class BoxIndex:
    """Blocks of clusters and the levels of boxes above them, the lowest first: box i is block i."""

    clusters: DataFrame
    levels: list[DataFrame]
    counts: list[int]
    model: LossModel
    hierarchy: Hierarchy
    order: Order

    @staticmethod
    def of(made: DataFrame, model: LossModel, hierarchy: Hierarchy) -> "BoxIndex":
        """``made`` are profiles with ``__no`` and ``__name``, see ``cohorts.profiles``; there is at least one."""
        roles, size = model.roles, F.col(SIZE)
        middles = [(from_columns(q, "lo").cast("double") + from_columns(q, "hi")) / 2 for q in roles.numeric_quasi]
        curves = []
        if middles:
            valued = made.withColumns({f"__r{i}": m for i, m in enumerate(middles)})
            curves = rank_curves(valued, made.count(), len(middles), "__name")
        trees = [q for q in roles.category_quasi if hierarchy.has(q)]
        order = Order(roles, hierarchy, level_worths(hierarchy, trees), curves)
        owns = {f"__own{i}": term for i, term in enumerate(model.own_terms(from_columns, size))}
        clusters = order.blocks(made.withColumns(owns), middles, "ulo", ["__no", "__name"])

        low, high = {"n": F.col(SIZE)}, {}
        for i, q in enumerate([*roles.numeric_quasi, *roles.category_quasi]):
            whole = "nn" if q in roles.numeric_quasi else "mapped"
            low |= {f"lo{i}": from_columns(q, "lo"), f"own{i}": F.col(f"__own{i}")}
            low[f"whole{i}"] = from_columns(q, whole) == size
            high |= {f"hi{i}": from_columns(q, "hi"), f"most{i}": F.col(f"__own{i}")}
            if q in roles.category_quasi:  # texts in no tree, and whether every cluster holds nothing else
                low |= {f"ulo{i}": from_columns(q, "ulo")}
                low[f"bare{i}"] = (from_columns(q, "mapped") == 0) & (from_columns(q, "nn") == size)
                high |= {f"uhi{i}": from_columns(q, "uhi")}
        level = BoxIndex._grown(clusters, F.col("block"), low, high)
        levels, counts = [], []
        while True:
            levels.append(cut_lineage(BoxIndex._with_paths(level, model, hierarchy)))
            counts.append(levels[-1].count())
            if counts[-1] <= TOP:
                return BoxIndex(clusters, levels, counts, model, hierarchy, order)
            names = [{n: F.col(n) for n in side} for side in (low, high)]
            level = BoxIndex._grown(levels[-1], div(F.col("box"), FANOUT), *names)

    @staticmethod
    def _grown(below: DataFrame, box: Column, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
        least = [F.min(c).alias(n) for n, c in low.items()]
        return below.groupBy(box.alias("box")).agg(*least, *(F.max(c).alias(n) for n, c in high.items()))

    @staticmethod
    def _with_paths(level: DataFrame, model: LossModel, hierarchy: Hierarchy) -> DataFrame:
        """Adds, per category, the paths from the root to the least and the greatest node of each box."""
        first = len(model.roles.numeric_quasi)
        for i, q in enumerate(model.roles.category_quasi, first):
            if not hierarchy.has(q):
                continue
            for side in ("lo", "hi"):
                nodes = hierarchy.nodes(q).select(
                    F.col("pre").alias("__at"),
                    F.col("anc_pre").alias(f"{side}{i}_pre"),
                    F.col("anc_last").alias(f"{side}{i}_last"),
                    scaled_heights().alias(f"{side}{i}_height"),
                )
                level = level.join(nodes, F.col(f"{side}{i}") == F.col("__at"), "left").drop("__at")
        return level

    def bound(self) -> Column:
        """Least rise of loss when a row of a block (``v<i>``, ``w<i>``, ``known<i>``) joins a cluster in a box."""
        roles, more = self.model.roles, F.col("n") + 1
        terms = []
        for i, q in enumerate(roles.numeric_quasi):
            own, width = F.col(f"own{i}"), self.model.width(q)
            if not width:
                terms.append(own)
                continue
            away = F.greatest(
                F.col(f"lo{i}").cast("double") - F.col(f"w{i}"), F.col(f"v{i}").cast("double") - F.col(f"hi{i}"), F.lit(0.0)
            )
            sure = F.col(f"whole{i}") & F.col(f"known{i}")
            terms.append(F.when(sure, own + more * away / F.lit(width)).otherwise(own))
        for i, q in enumerate(roles.category_quasi, len(roles.numeric_quasi)):
            own, most, depth = F.col(f"own{i}"), F.col(f"most{i}"), self.model.depths.get(q, 0)
            # a text in no tree costs a whole tree unless the cluster holds just this text
            other = (F.col(f"uw{i}") < F.col(f"ulo{i}")) | (F.col(f"uv{i}") > F.col(f"uhi{i}"))
            apart = F.col(f"bare{i}") & F.col(f"told{i}") & other
            stray = F.when(apart, F.greatest(own, more - F.col("n") * most)).otherwise(own)
            if not depth or not self.hierarchy.has(q):
                terms.append(stray)
                continue

            def height(side: str, lo: Column, hi: Column) -> Column:
                shared = shared_depth(F.col(f"{side}_pre"), F.col(f"{side}_last"), lo, hi, depth)
                return F.get(F.col(f"{side}_height"), shared - 1)

            lo, hi, v, w = (F.col(f"{x}{i}") for x in ("lo", "hi", "v", "w"))
            joined = F.when(w < lo, height(f"lo{i}", w, lo)).when(v > hi, height(f"hi{i}", hi, v)).otherwise(0.0)
            rise = more * joined - F.col("n") * F.least(most, joined)
            sure = F.col(f"whole{i}") & F.col(f"known{i}")
            terms.append(F.when(sure, F.greatest(own, rise)).otherwise(stray))
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    def away(self) -> Column:
        """How far the middles of a block of rows and of a box are apart: a tie-break among equal bounds."""
        count = len(self.model.roles.numeric_quasi) + len(self.model.roles.category_quasi)

        def gap(i: int) -> Column:
            lo, hi, v, w = (F.col(f"{x}{i}").cast("double") for x in ("lo", "hi", "v", "w"))
            return F.coalesce(F.abs(lo + hi - v - w) / F.greatest(F.abs(hi - lo) + F.abs(w - v), F.lit(1e-9)), F.lit(0.0))

        return reduce(lambda a, b: a + b, [gap(i) for i in range(count)], F.lit(0.0))

    def down(self, rows: DataFrame, keep) -> DataFrame:
        """``rows`` (row blocks with bounds) with ``box``: the blocks of clusters left by ``keep`` at every level."""
        top = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.counts[-1] - 1).cast("long")))
        pairs = rows.withColumn("box", top)
        for at in range(len(self.levels) - 1, -1, -1):
            met = pairs.join(self.levels[at], "box").withColumns({"bound": self.bound(), "away": self.away()})
            pairs = cut_lineage(keep(met).select(*rows.columns, "box", "bound"))
            if at:
                first = F.col("box") * FANOUT
                last = F.least(first + FANOUT - 1, F.lit(self.counts[at - 1] - 1))
                pairs = pairs.drop("bound").withColumn("box", F.explode(F.sequence(first, last)))
        return pairs


def nearest_blocks(index: BoxIndex, rows: DataFrame, meet) -> tuple[DataFrame, DataFrame]:
    """(best, visits) of blocks of rows: what ``meet`` finds in the blocks that cannot be ruled out.

    ``rows`` are the bounds of row blocks, ``meet`` turns (row_block, box) pairs into (row_block, id, delta, no, name),
    the best of each row per pair. Every block of rows first visits HOME blocks of least bound; the worst of
    its best losses there then rules out all boxes whose bound is above it.
    """
    close = Window.partitionBy("row_block").orderBy("bound", "away", "box")

    def nearest(met: DataFrame) -> DataFrame:
        return met.withColumn("__r", F.row_number().over(close)).where(F.col("__r") <= HOME)

    homes = index.down(rows, nearest).select("row_block", "box")
    found = cut_lineage(meet(homes))
    worst = found.groupBy("row_block", "id").agg(F.min("delta").alias("delta"))
    worst = worst.groupBy("row_block").agg(F.max("delta").alias("limit"))
    limited = rows.join(worst, "row_block")
    left = index.down(limited, lambda met: met.where(F.col("bound") <= F.col("limit") + SLACK))
    others = left.select("row_block", "box").join(homes, ["row_block", "box"], "left_anti")
    return found.unionByName(meet(others)), homes.unionByName(others)


def best_clusters(
    made: DataFrame, rows: DataFrame, model: LossModel, hierarchy: Hierarchy
) -> tuple[DataFrame, DataFrame]:
    """((id, name) of the cluster each row joins best, the (row_block, box) pairs that were compared).

    ``made`` are profiles with ``__no`` and ``__name``, ``rows`` have ``__id`` and the fields of ``attach_nodes``, paths included.
    Exact: blocks that are not visited hold no better and no equal cluster. Ties go to the least number, then name.
    """
    roles = model.roles
    made, rows = cut_lineage(made), cut_lineage(rows)
    kind = rows.schema["__id"].dataType.simpleString()
    if made.isEmpty() or rows.isEmpty():
        spark = made.sparkSession
        return spark.createDataFrame([], f"id {kind}, name string"), spark.createDataFrame([], "row_block long, box long")
    index = BoxIndex.of(made, model, hierarchy)
    numbers = [from_columns(q, "v") for q in roles.numeric_quasi]
    at = numbers + [from_columns(q, "pre") for q in roles.category_quasi]
    placed = index.order.blocks(rows, numbers, "u", ["__id"]).withColumnRenamed("block", "row_block")
    placed = placed.drop(*(name_of(q, f) for q in roles.category_quasi for f in PATH_FIELDS))
    sides = {f"v{i}": F.min(c) for i, c in enumerate(at)} | {f"w{i}": F.max(c) for i, c in enumerate(at)}
    sides |= {f"known{i}": F.count(c) == F.count(F.lit(1)) for i, c in enumerate(at)}
    for i, q in enumerate(roles.category_quasi, len(numbers)):
        u = from_columns(q, "u")
        sides |= {f"uv{i}": F.min(u), f"uw{i}": F.max(u), f"told{i}": F.count(u) == F.count(F.lit(1))}
    bounds = cut_lineage(placed.groupBy("row_block").agg(*[c.alias(n) for n, c in sides.items()]))

    def gathered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
        fields = [*order, *(c for c in df.columns if c.startswith("__") and c not in order)]
        every = F.struct(*[F.col(quoted(c)) for c in fields])
        return cut_lineage(df.groupBy(key).agg(F.array_sort(F.collect_list(every)).alias(name)))

    groups = gathered(index.clusters.drop(*(c for c in index.clusters.columns if c.startswith("__own"))), "block", ["__no", "__name"], "groups")
    people = gathered(placed, "row_block", ["__id"], "rows")
    work = gains.best_worker(SIZE, *gain_fields(model), to_arrow_type(rows.schema["__id"].dataType))

    def meet(pairs: DataFrame) -> DataFrame:
        met = pairs.join(groups.withColumnRenamed("block", "box"), "box").join(people, "row_block")
        return met.select("row_block", "groups", "rows").mapInArrow(
            work, f"row_block long, id {kind}, delta double, no long, name string"
        )

    found, visits = nearest_blocks(index, bounds, meet)
    best = found.groupBy("id").agg(F.min(F.struct("delta", "no", "name")).alias("b"))
    return best.select("id", F.col("b.name").alias("name")), visits


def gain_fields(model: LossModel) -> tuple[list[dict], list[dict]]:
    """The names of the fields that the kernel reads, per numeric and per category column."""

    def names(q: str, wanted: tuple[str, ...]) -> dict:
        return {f: name_of(q, f) for f in wanted}

    numeric = [names(q, ("lo", "hi", "nn", "v")) | {"width": model.width(q)} for q in model.roles.numeric_quasi]
    parts = ("lo", "hi", "mapped", "nn", "ulo", "uhi", "anc_pre", "anc_last", "anc_height", "pre", "u")
    category = [names(q, parts) | {"depth": model.depths.get(q, 0)} for q in model.roles.category_quasi]
    return numeric, category
