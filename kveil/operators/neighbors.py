"""Record distances, information loss, and the searches built on them.

A single record or cluster is fetched once and enters the plan as literals, so searching a table
for its furthest record, best record or best cluster is one scan with a top-1 and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.functions.metrics import (
    METRICS,
    Getter,
    LossModel,
    category_distance_reference,
    category_loss_reference,
    numeric_distance,
    numeric_loss_reference,
    total,
)
from kveil.operators.boxes import best_clusters
from kveil.operators.cohorts import (
    SIZE,
    attach_nodes,
    from_columns,
    from_row,
    loss_model,
    name_of,
    profiles,
)
from kveil.operators.hierarchy import Hierarchy, lca_pairs
from kveil.sources.config import Roles


def _even(measure: Column) -> Column:
    """Equal measures compare equal whatever order their terms were added in."""
    return F.round(measure, 9)


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def _one(df: DataFrame, what: str):
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected exactly one {what}, found {'none' if not rows else 'several'}")
    return rows[0]


def _record(record: DataFrame, roles: Roles, hierarchy: Hierarchy):
    """The one row of ``record`` with its nodes, and the types of the added columns."""
    enriched = attach_nodes(record, roles, hierarchy, paths=True)
    return _one(enriched, "record"), dict(enriched.dtypes)


def _as_group(row, types, roles: Roles) -> Getter:
    """A group that holds just this record."""
    base = from_row(row, types)

    def get(attr: str, field: str) -> Column:
        if attr in roles.numeric_quasi:
            v = row[name_of(attr, "v")]
            return F.lit(int(v is not None)) if field == "nn" else base(attr, "v")
        pre, u = row[name_of(attr, "pre")], row[name_of(attr, "u")]
        if field == "mapped":
            return F.lit(int(pre is not None))
        if field == "nn":
            return F.lit(int(pre is not None or u is not None))
        return base(attr, {"lo": "pre", "hi": "pre", "ulo": "u", "uhi": "u"}.get(field, field))

    return get


def record_distance(
    df: DataFrame,
    record: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    domain: dict | None = None,
    metric: str = "paper",
) -> DataFrame:
    """Adds ``distance``: of every row from the one row of ``record``, summed over the quasi-identifiers."""
    _check(metric)
    if metric == "reference":
        return _record_distance_reference(df, record, roles, hierarchy, domain)
    model = loss_model(df, roles, hierarchy, domain)
    row, types = _record(record, roles, hierarchy)
    rows = attach_nodes(df, roles, hierarchy)
    distance = model.union_loss(_as_group(row, types, roles), F.lit(1), from_columns)
    return rows.withColumn("distance", distance).select(*[F.col(quoted(c)) for c in df.columns], "distance")


def _record_distance_reference(df, record, roles, hierarchy, domain):
    model = loss_model(df, roles, hierarchy, domain)
    row = _one(record, "record")
    out, terms = df, []
    for q in roles.numeric_quasi:
        lo, hi = model.domain[q]
        terms.append(numeric_distance(F.col(quoted(q)), F.lit(row[q]).cast("int"), F.lit(lo), F.lit(hi), "reference"))
    for q in roles.category_quasi:
        if not hierarchy.has(q):
            continue
        other = name_of(q, "other")
        pairs = lca_pairs(out.withColumn(other, F.lit(row[q])), q, other, hierarchy, q)
        out = pairs.withColumnRenamed("lca_level", name_of(q, "level")).drop("lca", "lca_height", other)
        terms.append(category_distance_reference(from_columns(q, "level"), F.lit(hierarchy.levels(q))))
    return out.withColumn("distance", total(terms)).select(
        *[F.col(quoted(c)) for c in df.columns], "distance"
    )


def category_distance(
    df: DataFrame, a: str, b: str, hierarchy: Hierarchy, attr: str, metric: str = "paper"
) -> DataFrame:
    """Adds ``distance`` of the values in columns ``a`` and ``b`` within the tree of ``attr``."""
    _check(metric)
    pairs = lca_pairs(df, a, b, hierarchy, attr)
    if metric == "reference":
        d = category_distance_reference(F.col("lca_level"), F.lit(hierarchy.levels(attr)))
    else:
        height = max(hierarchy.height.get(attr, 0), 1)
        d = F.when(F.col(quoted(a)).eqNullSafe(F.col(quoted(b))), 0.0).otherwise(
            F.coalesce(F.col("lca_height") / F.lit(float(height)), F.lit(1.0))
        )
    return pairs.withColumn("distance", d).drop("lca", "lca_level", "lca_height")


def furthest(
    df: DataFrame, record: DataFrame, roles: Roles, hierarchy: Hierarchy, domain=None, key: str = "id"
) -> DataFrame:
    """The row furthest from ``record``; ties go to the least key."""
    found = record_distance(df, record, roles, hierarchy, domain)
    return found.orderBy(_even(F.col("distance")).desc(), quoted(key)).limit(1)


def info_loss(
    df: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    cluster: str = "Cluster",
    domain: dict | None = None,
    metric: str = "paper",
) -> DataFrame:
    """One row per cluster: its size and its information loss, size times loss per row."""
    _check(metric)
    made = profiles(df, roles, hierarchy, cluster)
    size = F.col(SIZE)
    if metric == "paper":
        per_row = loss_model(df, roles, hierarchy, domain).own_loss(from_columns, size)
    else:
        per_row = total(
            [numeric_loss_reference(from_columns(q, "lo"), from_columns(q, "hi"), size) for q in roles.numeric_quasi]
            + [category_loss_reference(hierarchy.levels(q)) for q in roles.category_quasi if hierarchy.has(q)]
        )
    return made.select(
        F.col(quoted(cluster)), size.alias("n"), (size * per_row).alias("info_loss")
    )


def total_info_loss(
    df: DataFrame, roles: Roles, hierarchy: Hierarchy, cluster: str = "Cluster", domain=None, metric="paper"
) -> DataFrame:
    per_cluster = info_loss(df, roles, hierarchy, cluster, domain, metric)
    return per_cluster.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("rows"), F.sum("info_loss").alias("info_loss")
    )


def delta_info_loss(
    df: DataFrame,
    members: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    domain: dict | None = None,
) -> DataFrame:
    """Adds ``delta``: the rise in information loss were the row to join the cluster ``members``."""
    model = loss_model(df.select(*[quoted(a.name) for a in roles.quasi]), roles, hierarchy, domain)
    one = profiles(members.withColumn("__one", F.lit(1)), roles, hierarchy, "__one")
    row = _one(one, "cluster")
    group = from_row(row, dict(one.dtypes))
    rows = attach_nodes(df, roles, hierarchy)
    delta = model.gain(group, F.lit(row[SIZE]), from_columns)
    return rows.withColumn("delta", delta).select(*[F.col(quoted(c)) for c in df.columns], "delta")


def best_record(
    df: DataFrame, members: DataFrame, roles: Roles, hierarchy: Hierarchy, domain=None, key: str = "id"
) -> DataFrame:
    """The row that adds least information loss to the cluster; ties go to the least key."""
    found = delta_info_loss(df, members, roles, hierarchy, domain)
    return found.orderBy(_even(F.col("delta")), quoted(key)).limit(1)


def best_cluster(
    clustered: DataFrame,
    record: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    domain: dict | None = None,
    cluster: str = "Cluster",
) -> DataFrame:
    """The cluster whose information loss rises least when ``record`` joins it."""
    model = loss_model(clustered, roles, hierarchy, domain)
    row, types = _record(record, roles, hierarchy)
    made = profiles(clustered, roles, hierarchy, cluster)
    delta = model.gain(from_columns, F.col(SIZE), from_row(row, types))
    found = made.select(F.col(quoted(cluster)), delta.alias("delta"))
    return found.orderBy(_even(F.col("delta")), *cluster_order(cluster)).limit(1)


def cluster_order(cluster: str) -> list[Column]:
    """``Cluster 2`` before ``Cluster 10``; other names by text."""
    return [cluster_number(cluster).asc_nulls_last(), F.col(quoted(cluster))]


def cluster_number(cluster: str) -> Column:
    return F.regexp_extract(F.col(quoted(cluster)).cast("string"), r"(\d+)$", 1).try_cast("long")


def assign_leftovers(
    leftovers: DataFrame,
    clustered: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    domain: dict | None = None,
    cluster: str = "Cluster",
    key: str = "id",
) -> DataFrame:
    """``leftovers`` with the best cluster of each, judged against the clusters as they stand.

    Clusters and leftovers are cut into blocks of neighbours, and a tree of boxes over the clusters rules out
    the blocks that hold no best cluster, see ``boxes``. Leftovers without a key get no cluster; without
    clusters there is none to give.
    """
    model = loss_model(clustered, roles, hierarchy, domain)
    enriched = attach_nodes(leftovers, roles, hierarchy, paths=True)
    fields = [c for c in enriched.columns if c.startswith("__")]
    made = profiles(clustered, roles, hierarchy, cluster).where(F.col(quoted(cluster)).isNotNull())
    order = F.coalesce(cluster_number(cluster), F.lit(2**62))
    described = [c for c in made.columns if c.startswith("__")]
    made = made.select(order.alias("__no"), F.col(quoted(cluster)).cast("string").alias("__name"), *map(quoted, described))
    rows = enriched.select(F.col(quoted(key)).alias("__id"), *map(quoted, fields)).where("__id IS NOT NULL")
    chosen, _ = best_clusters(made, rows, model, hierarchy)
    chosen = chosen.select(F.col("id").alias("__left"), F.col("name").alias(cluster))
    return leftovers.join(chosen, F.col(quoted(key)) == F.col("__left"), "left").drop("__left")
