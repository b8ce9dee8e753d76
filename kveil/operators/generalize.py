"""k-anonymous generalization of clustered rows, and the checks on its result."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.functions.metrics import shared_depth
from kveil.operators.cohorts import SIZE, from_columns, profiles, profiles_inline, with_paths
from kveil.operators.hierarchy import Hierarchy
from kveil.session import SMALL_ROWS, settle
from kveil.sources.config import Roles

SUPPRESSED = "*"
# rows of a cluster above this size meet its bounds by broadcast, not in one task
HOT_ROWS = 200_000


def numeric_label(q: str) -> Column:
    """``[min-max]`` when the cluster holds more than one value (NULL counts as one), else the value."""
    lo, hi, nn = (from_columns(q, f) for f in ("lo", "hi", "nn"))
    mixed = (lo != hi) | ((nn > 0) & (nn < F.col(SIZE)))
    text = F.concat(F.lit("["), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("]"))
    return F.when(mixed, text).otherwise(lo.cast("string"))


def category_label(q: str, hierarchy: Hierarchy, level: str | int) -> Column:
    """The cluster's ancestor when it holds more than one value, else the value."""
    lo, hi, mapped, nn, ulo, uhi = (
        from_columns(q, f) for f in ("lo", "hi", "mapped", "nn", "ulo", "uhi")
    )
    root = F.lit(hierarchy.root.get(q, SUPPRESSED))
    path = from_columns(q, "path")
    depth = hierarchy.depth(q)
    if level == "root" or depth == 0:
        common = root
    else:
        d = shared_depth(from_columns(q, "anc_pre"), from_columns(q, "anc_last"), lo, hi, depth)
        if level != "lca":
            d = F.least(F.lit(int(level)), d)
        common = F.get(path, d - 1)
    return (
        F.when(nn == 0, F.lit(None).cast("string"))
        .when(mapped == F.col(SIZE), F.when(lo == hi, F.get(path, F.size(path) - 1)).otherwise(common))
        .when((mapped > 0) | (nn < F.col(SIZE)) | (ulo != uhi), root)
        .otherwise(ulo)
    )


def labels(roles: Roles, hierarchy: Hierarchy, level: str | int) -> dict[str, Column]:
    out = {}
    for a in roles.quasi:
        out[a.name] = numeric_label(a.name) if a.is_numeric else category_label(a.name, hierarchy, level)
    return out


def k_anonymize(
    df: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    cluster: str = "Cluster",
    level: str | int = "lca",
    bounded: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replaces every quasi-identifier by one label per cluster; other columns pass, ``cluster`` goes.

    ``level`` is ``"lca"``, ``"root"``, or a tree level that is never passed downward from the
    cluster's common ancestor. A category without hierarchy is suppressed to ``*``. A row without
    a cluster loses all its quasi-identifiers.

    Clusters may be of any size. One count over the cluster column finds hot ones; their bounds
    come from a partial-then-final aggregate and reach their rows by broadcast, so those rows are
    not shuffled. The rows of all other clusters meet in one shuffle. ``bounded=True`` promises
    small clusters, such as those of ``greedy_k_member``, and spares the count.
    """
    warn_of_suppression(roles, hierarchy)
    text = labels(roles, hierarchy, level)
    hot = None if bounded else hottest_clusters(df, cluster, hot_rows)
    if hot is None:
        return _label_inline(df, roles, hierarchy, cluster, text)
    key = F.col(quoted(cluster))
    is_hot = key.eqNullSafe(F.col("__hot"))
    cold = df.join(F.broadcast(hot), is_hot, "left_anti")
    warm = df.join(F.broadcast(hot), is_hot, "left_semi")
    made = profiles(warm, roles, hierarchy, cluster, names=True).select(
        key.alias("__cluster"), *[c.alias(f"__label__{n}") for n, c in text.items()]
    )
    labelled = warm.join(F.broadcast(made), key == F.col("__cluster"), "left")
    out = labelled.select(
        *[
            F.col(quoted(f"__label__{c}")).alias(c) if c in text else F.col(quoted(c))
            for c in df.columns
            if c != cluster
        ]
    )
    return out.unionByName(_label_inline(cold, roles, hierarchy, cluster, text))


def profiled_labels(assigned: DataFrame, roles: Roles, hierarchy: Hierarchy, level: str | int = "lca") -> DataFrame:
    """``assigned`` with the profile fields of each row's cluster replaced by the labels ``__label__<column>``.

    A projection and a lookup of nodes: the rows of a cluster need not meet again.
    """
    warn_of_suppression(roles, hierarchy)
    named = with_paths(assigned, roles, hierarchy, names=True)
    own = [c for c in assigned.columns if c in ("__key", "Cluster", "Info")]
    return named.select(*own, *[c.alias(f"__label__{n}") for n, c in labels(roles, hierarchy, level).items()])


def warn_of_suppression(roles: Roles, hierarchy: Hierarchy) -> None:
    bare = [q for q in roles.category_quasi if not hierarchy.has(q)]
    if bare:
        warnings.warn(f"no hierarchy for {bare}: mixed values become '{SUPPRESSED}'", stacklevel=3)


def _label_inline(df, roles: Roles, hierarchy: Hierarchy, cluster: str, text: dict[str, Column]) -> DataFrame:
    rows = profiles_inline(df, roles, hierarchy, cluster, names=True)
    grouped = F.col(quoted(cluster)).isNotNull()
    return rows.select(
        *[
            F.when(grouped, text[c]).alias(c) if c in text else F.col(quoted(c))
            for c in df.columns
            if c != cluster
        ]
    )


def hottest_clusters(df: DataFrame, cluster: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Names of the clusters above ``hot_rows`` rows, the largest ``SMALL_ROWS`` of them; None if none is.

    No other cluster can then hold more than ``max(hot_rows, rows / SMALL_ROWS)`` rows.
    """
    sizes = df.groupBy(F.col(quoted(cluster)).alias("__hot")).agg(F.count(F.lit(1)).alias(SIZE))
    top = sizes.where(F.col(SIZE) > hot_rows).orderBy(F.desc(SIZE), "__hot").limit(SMALL_ROWS)
    hot, found = settle(top.select("__hot"))
    return None if found == 0 else hot


def verify_k(df: DataFrame, qi: list[str]) -> DataFrame:
    """One row: classes of equal quasi-identifiers, rows, size of the smallest class."""
    sizes = df.groupBy(*[quoted(q) for q in qi]).agg(F.count(F.lit(1)).alias(SIZE))
    return sizes.agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum(SIZE), F.lit(0)).alias("rows"),
        F.min(SIZE).alias("min_class_size"),
    )


def coverage(before: DataFrame, after: DataFrame, qi: list[str], id_col: str = "id") -> DataFrame:
    """One row: rows whose quasi-identifier text changed, rows unchanged, rows missing after, and the shares."""
    old = before.select(quoted(id_col), *[F.col(quoted(q)).cast("string").alias(f"__old_{q}") for q in qi])
    new = after.select(quoted(id_col), *[F.col(quoted(q)).cast("string").alias(f"__new_{q}") for q in qi])
    changed = F.lit(False)
    for q in qi:
        changed = changed | ~F.col(quoted(f"__old_{q}")).eqNullSafe(F.col(quoted(f"__new_{q}")))
    gone = F.col("__there").isNull()
    joined = old.join(new.withColumn("__there", F.lit(1)), id_col, "left").select(
        F.when(~gone, changed.cast("int")).alias("c"), gone.cast("int").alias("gone")
    )
    rows = F.count(F.lit(1))
    return joined.agg(
        rows.alias("rows"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("anonymized"),
        F.coalesce(F.sum(1 - F.col("c")), F.lit(0)).alias("not_anonymized"),
        F.coalesce(F.sum("gone"), F.lit(0)).alias("removed"),
        F.round(F.sum("c") / rows, 4).alias("anonymized_share"),
        F.round(F.sum(1 - F.col("c")) / rows, 4).alias("not_anonymized_share"),
    )
