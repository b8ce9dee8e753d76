"""Groups of rows (clusters) and single rows in the form the loss expressions take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.functions.metrics import Getter, LossModel
from kveil.operators.hierarchy import Hierarchy, lookup
from kveil.sources.config import Roles

SIZE = "__size"
PATH_FIELDS = ("anc_pre", "anc_last", "anc_height")


def name_of(attr: str, field: str) -> str:
    return f"__{attr}__{field}"


def from_columns(attr: str, field: str) -> Column:
    return F.col(quoted(name_of(attr, field)))


def from_row(row, types: dict[str, str]) -> Getter:
    """Literals of one fetched row, so that comparing every record with it needs no join."""

    def get(attr: str, field: str) -> Column:
        name = name_of(attr, field)
        return F.lit(row[name]).cast(types[name])

    return get


def domain_of(df: DataFrame, roles: Roles) -> dict[str, tuple]:
    """Least and greatest value of every numeric quasi-identifier, in one pass."""
    names = roles.numeric_quasi
    if not names:
        return {}
    row = df.agg(
        *[F.min(quoted(q)).alias(f"lo{i}") for i, q in enumerate(names)],
        *[F.max(quoted(q)).alias(f"hi{i}") for i, q in enumerate(names)],
    ).first()
    return {q: (row[f"lo{i}"], row[f"hi{i}"]) for i, q in enumerate(names)}


def loss_model(df: DataFrame, roles: Roles, hierarchy: Hierarchy, domain=None) -> LossModel:
    return LossModel(roles, domain or domain_of(df, roles), hierarchy.depths)


def scaled_heights() -> Column:
    h = F.greatest(F.col("tree_height"), F.lit(1)).cast("double")
    return F.transform("anc_height", lambda x: x / h)


def attach_nodes(df: DataFrame, roles: Roles, hierarchy: Hierarchy, paths: bool = False) -> DataFrame:
    """Adds ``v`` of numeric and ``pre``, ``u`` of category columns; with ``paths`` also the node's path."""
    out = df
    for q in roles.category_quasi:
        if hierarchy.has(q):
            fields = {name_of(q, "pre"): "pre"}
            if paths:
                fields |= {name_of(q, "anc_pre"): "anc_pre", name_of(q, "anc_last"): "anc_last"}
                fields[name_of(q, "anc_height")] = scaled_heights()
            out = lookup(out, q, hierarchy.closure, q, fields)
        else:
            out = out.withColumn(name_of(q, "pre"), F.lit(None).cast("int"))
            if paths:
                out = _no_path(out, q)
    extra = {name_of(q, "v"): F.col(quoted(q)) for q in roles.numeric_quasi}
    extra |= {
        name_of(q, "u"): F.when(from_columns(q, "pre").isNull(), F.col(quoted(q)))
        for q in roles.category_quasi
    }
    return out.withColumns(extra)


def _no_path(df: DataFrame, q: str) -> DataFrame:
    return df.withColumns(
        {
            name_of(q, "anc_pre"): F.lit(None).cast("array<int>"),
            name_of(q, "anc_last"): F.lit(None).cast("array<int>"),
            name_of(q, "anc_height"): F.lit(None).cast("array<double>"),
        }
    )


def _bounds(roles: Roles, hierarchy: Hierarchy, over=None) -> dict[str, Column]:
    """Aggregates that describe a group; as window columns when ``over`` is given."""
    agg = {SIZE: F.count(F.lit(1))}
    for q in roles.numeric_quasi:
        v = F.col(quoted(q))
        agg |= {name_of(q, "lo"): F.min(v), name_of(q, "hi"): F.max(v), name_of(q, "nn"): F.count(v)}
    for q in roles.category_quasi:
        pre, u = from_columns(q, "pre"), from_columns(q, "u")
        agg |= {
            name_of(q, "lo"): F.min(pre),
            name_of(q, "hi"): F.max(pre),
            name_of(q, "mapped"): F.count(pre),
            name_of(q, "nn"): F.count(quoted(q)),
            name_of(q, "ulo"): F.min(u),
            name_of(q, "uhi"): F.max(u),
        }
    return agg if over is None else {n: c.over(over) for n, c in agg.items()}


def with_paths(profile: DataFrame, roles: Roles, hierarchy: Hierarchy, names: bool = False) -> DataFrame:
    """Adds to each profile the path of every category's least node (with ``names`` also its texts)."""
    out = profile
    for q in roles.category_quasi:
        if not hierarchy.has(q):
            out = _no_path(out, q)
            if names:
                out = out.withColumn(name_of(q, "path"), F.lit(None).cast("array<string>"))
            continue
        fields = {
            name_of(q, "key"): F.col("pre"),
            name_of(q, "anc_pre"): F.col("anc_pre"),
            name_of(q, "anc_last"): F.col("anc_last"),
            name_of(q, "anc_height"): scaled_heights(),
        }
        if names:
            fields[name_of(q, "path")] = F.col("path")
        nodes = hierarchy.nodes(q).select(*[c.alias(n) for n, c in fields.items()])
        key = name_of(q, "key")
        out = out.join(nodes, from_columns(q, "lo") == F.col(quoted(key)), "left").drop(key)
    return out


def profiles(
    df: DataFrame, roles: Roles, hierarchy: Hierarchy, cluster: str = "Cluster", names: bool = False
) -> DataFrame:
    """One row per cluster: size and bounds of every quasi-identifier."""
    rows = attach_nodes(df, roles, hierarchy)
    bounds = _bounds(roles, hierarchy)
    grouped = rows.groupBy(quoted(cluster)).agg(*[c.alias(n) for n, c in bounds.items()])
    return with_paths(grouped, roles, hierarchy, names)


def profiles_inline(
    df: DataFrame, roles: Roles, hierarchy: Hierarchy, cluster: str, names: bool = False
) -> DataFrame:
    """The rows themselves with their cluster's profile beside them, by one shuffle.

    All rows of a cluster meet in one task: only for clusters of bounded size.
    """
    rows = attach_nodes(df, roles, hierarchy)
    over = Window.partitionBy(quoted(cluster))
    rows = rows.withColumns(_bounds(roles, hierarchy, over))
    return with_paths(rows, roles, hierarchy, names)
