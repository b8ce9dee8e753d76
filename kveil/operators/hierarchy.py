"""Generalization hierarchies as tables: path closure, checks, ancestors, common ancestors.

A hierarchy row is ``(attr, value, parent, level, position)``. The closure has one row per node:

* ``path`` names the nodes from the root, ``depth`` counts them, ``level`` is the level given;
* ``pre`` numbers the nodes in preorder and ``last`` is the greatest number below the node, so a
  node is an ancestor of exactly the numbers ``pre..last``. A whole group of values then has its
  lowest common ancestor on the path of its least number: the deepest node whose ``last``
  reaches the greatest one. Two integer aggregates are all a group needs;
* ``height`` is the height of the node's subtree and ``tree_height`` that of the tree, in edges;
* ``anc_pre``, ``anc_last``, ``anc_height``, ``anc_level`` repeat those along the path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.functions.metrics import shared_depth
from kveil.operators.project import with_dense_id
from kveil.session import SMALL_ROWS, settle

NOT_FOUND = "not found"
MAX_DEPTH = 64


def _nodes(dgh: DataFrame) -> DataFrame:
    """One row per (attr, value): the one with the least level, then parent."""
    return (
        dgh.where(F.col("value").isNotNull())
        .groupBy("attr", "value")
        .agg(F.min(F.struct("level", "parent")).alias("s"), F.count("*").alias("copies"))
        .select("attr", "value", "s.level", "s.parent", "copies")
    )


def _roots(nodes: DataFrame) -> DataFrame:
    top = nodes.where(F.col("parent").isNull() | (F.col("parent") == F.col("value")))
    return top.groupBy("attr").agg(F.min(F.struct("level", "value"))["value"].alias("root"))


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with the parent they really hang on; orphans and further roots hang on the root."""
    known = nodes.select("attr", F.col("value").alias("parent"), F.lit(True).alias("known"))
    own_parent = F.col("parent").isNull() | (F.col("parent") == F.col("value"))
    return (
        nodes.join(_roots(nodes), "attr")
        .join(known, ["attr", "parent"], "left")
        .select(
            "attr",
            "value",
            "level",
            "root",
            F.when(F.col("value") == F.col("root"), None)
            .when(own_parent | F.col("known").isNull(), F.col("root"))
            .otherwise(F.col("parent"))
            .alias("up"),
            (~own_parent & F.col("known").isNull()).alias("orphan"),
            (own_parent & (F.col("value") != F.col("root"))).alias("extra_root"),
        )
    )


def _doubled(walk: DataFrame) -> DataFrame:
    """Puts the path of the node at ``up`` before each path, which doubles the steps walked."""
    above = walk.select(
        "attr",
        F.col("value").alias("up"),
        F.col("up").alias("next_up"),
        F.col("path").alias("up_path"),
        F.col("anc_level").alias("up_level"),
    )
    return walk.join(above, ["attr", "up"], "left").select(
        "attr",
        "value",
        "level",
        F.col("next_up").alias("up"),
        F.when(F.col("up_path").isNull(), F.col("path")).otherwise(F.concat("up_path", "path")).alias("path"),
        F.when(F.col("up_path").isNull(), F.col("anc_level"))
        .otherwise(F.concat("up_level", "anc_level"))
        .alias("anc_level"),
    )


def dgh_closure(dgh: DataFrame) -> DataFrame:
    """The closure table described above.

    Paths grow by doubling: a tree of up to 4 levels takes one round, of up to 16 two, of up to
    ``MAX_DEPTH`` three. Nodes that never meet a root go round in a cycle and are left out.
    """
    nodes, _ = settle(_nodes(dgh))
    linked, size = settle(_linked(nodes))
    walk = linked.select(
        "attr", "value", "level", "up", F.array("value").alias("path"), F.array("level").alias("anc_level")
    )
    steps, open_ends = 1, F.col("up").isNotNull()
    while steps < MAX_DEPTH:
        walk, _ = settle(_doubled(_doubled(walk)))
        steps *= 4
        if not walk.where(open_ends).take(1):
            break
    else:
        if walk.where(open_ends & (F.size(F.array_distinct("path")) == F.size("path"))).take(1):
            raise ValueError(f"hierarchy is deeper than {MAX_DEPTH} levels")
    paths = walk.where(~open_ends).drop("up")
    if size is not None:
        order = Window.partitionBy("attr").orderBy("path")
        return _finish(paths.withColumn("pre", F.row_number().over(order)))
    numbered = with_dense_id(paths, ["attr", "path"], id_col="pre", unique=True)
    return _finish(numbered.withColumn("pre", F.col("pre").cast("int")))


def _finish(numbered: DataFrame) -> DataFrame:
    """Adds the spans and heights of the nodes, each node's own and those along its path."""
    steps = numbered.withColumn("depth", F.size("path")).select(
        "*", F.posexplode("path").alias("pos", "anc")
    )
    spans = (
        steps.groupBy(F.col("attr").alias("s_attr"), F.col("anc").alias("s_anc"))
        .agg(
            F.min("pre").alias("s_pre"),
            F.max("pre").alias("s_last"),
            (F.max("depth") - F.min("depth")).alias("s_height"),
        )
    )
    on = (F.col("attr") == F.col("s_attr")) & (F.col("anc") == F.col("s_anc"))
    chains = (
        steps.join(spans, on)
        .groupBy("attr", "value")
        .agg(
            *[F.any_value(c).alias(c) for c in ("level", "depth", "path", "anc_level", "pre")],
            F.sort_array(F.collect_list(F.struct("pos", "s_pre", "s_last", "s_height"))).alias("chain"),
        )
    )
    own = F.element_at("chain", -1)
    out = chains.select(
        "attr",
        "value",
        F.get("path", F.size("path") - 2).alias("parent"),
        F.coalesce("level", "depth").alias("level"),
        "depth",
        "path",
        "pre",
        own["s_last"].alias("last"),
        own["s_height"].alias("height"),
        F.col("chain")[0]["s_height"].alias("tree_height"),
        (own["s_height"] == 0).alias("is_leaf"),
        F.col("chain.s_pre").alias("anc_pre"),
        F.col("chain.s_last").alias("anc_last"),
        F.col("chain.s_height").alias("anc_height"),
        F.transform("anc_level", lambda given, i: F.coalesce(given, i + 1)).alias("anc_level"),
    )
    return settle(out)[0]


def dgh_validate(dgh: DataFrame) -> DataFrame:
    """Rows ``(attr, value, issue)``: orphan, extra_root, duplicate, unreachable."""
    nodes, _ = settle(_nodes(dgh))
    linked, _ = settle(_linked(nodes))
    found = [
        linked.where("orphan").select("attr", "value", F.lit("orphan").alias("issue")),
        linked.where("extra_root").select("attr", "value", F.lit("extra_root").alias("issue")),
        nodes.where("copies > 1").select("attr", "value", F.lit("duplicate").alias("issue")),
        nodes.join(dgh_closure(dgh), ["attr", "value"], "left_anti").select(
            "attr", "value", F.lit("unreachable").alias("issue")
        ),
    ]
    return reduce(DataFrame.unionByName, found)


def tree_height(closure: DataFrame, unit: str = "edges") -> DataFrame:
    """Height per attribute; ``levels`` counts nodes on the longest path, 0 for a lone root."""
    h = F.max("depth") - 1
    if unit == "levels":
        h = F.when(h == 0, 0).otherwise(h + 1)
    return closure.groupBy("attr").agg(h.cast("int").alias("height"))


@dataclass(frozen=True)
class Hierarchy:
    """A closure with the few figures per attribute that expressions need as literals."""

    closure: DataFrame
    root: dict[str, str]
    height: dict[str, int]
    span: dict[str, tuple[int, int]]

    @staticmethod
    def build(dgh: DataFrame) -> "Hierarchy":
        return Hierarchy.of(dgh_closure(dgh))

    @staticmethod
    def of(closure: DataFrame) -> "Hierarchy":
        tops = closure.where("depth = 1").select("attr", "value", "height", "pre", "last").collect()
        return Hierarchy(
            closure,
            {r.attr: r.value for r in tops},
            {r.attr: r.height for r in tops},
            {r.attr: (r.pre, r["last"]) for r in tops},
        )

    def has(self, attr: str) -> bool:
        return attr in self.root

    def depth(self, attr: str) -> int:
        """Nodes on the longest path; 0 without a tree."""
        return self.height[attr] + 1 if attr in self.height else 0

    def levels(self, attr: str) -> int:
        """Height counted in levels, where a lone root counts 0."""
        return 0 if self.height.get(attr, 0) == 0 else self.height[attr] + 1

    @property
    def small(self) -> bool:
        return sum(last - first + 1 for first, last in self.span.values()) <= SMALL_ROWS

    @property
    def depths(self) -> dict[str, int]:
        return {a: h + 1 for a, h in self.height.items()}

    def nodes(self, attr: str) -> DataFrame:
        return self.closure.where(F.col("attr") == attr)


def lookup(
    df: DataFrame, col: str, closure: DataFrame, attr: str, fields: dict[str, Column | str]
) -> DataFrame:
    """Left join of ``df[col]`` with the nodes of ``attr``, adding ``fields`` (new name -> field)."""
    key = "__node_value"
    nodes = closure.where(F.col("attr") == attr).select(
        F.col("value").alias(key),
        *[(F.col(f) if isinstance(f, str) else f).alias(n) for n, f in fields.items()],
    )
    return df.join(nodes, F.col(quoted(col)) == F.col(key), "left").drop(key)


def lca_pairs(df: DataFrame, a: str, b: str, hierarchy: Hierarchy, attr: str) -> DataFrame:
    """Adds ``lca``, ``lca_level`` and ``lca_height`` of the values in columns ``a`` and ``b``."""
    depth = hierarchy.depth(attr)
    out = lookup(
        df,
        a,
        hierarchy.closure,
        attr,
        {f"__a_{f}": f for f in ("path", "anc_pre", "anc_last", "anc_height", "anc_level")},
    )
    out = lookup(out, b, hierarchy.closure, attr, {"__b_pre": "pre"})
    at = shared_depth(
        F.col("__a_anc_pre"), F.col("__a_anc_last"), F.col("__b_pre"), F.col("__b_pre"), depth
    )
    # depth 0 means that one of the two is in no tree; get() then yields NULL
    return out.withColumn("__d", at - 1).select(
        *[F.col(quoted(c)) for c in df.columns],
        F.coalesce(F.get("__a_path", F.col("__d")), F.lit(NOT_FOUND)).alias("lca"),
        F.get("__a_anc_level", F.col("__d")).alias("lca_level"),
        F.get("__a_anc_height", F.col("__d")).alias("lca_height"),
    )


def ancestor_at(df: DataFrame, col: str, level: int, closure: DataFrame, attr: str) -> DataFrame:
    """Adds ``ancestor``: the node at ``level`` on the path of ``df[col]``, or the value itself above it."""
    out = lookup(df, col, closure, attr, {"__path": "path"})
    step = F.element_at("__path", F.least(F.lit(level), F.size("__path")))
    return out.withColumn("ancestor", F.when(F.col("__path").isNotNull(), step)).drop("__path")
