"""Job: read, choose and type columns, number rows, cluster, generalize, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.operators.cluster import assign_clusters
from kveil.operators.generalize import profiled_labels
from kveil.operators.hierarchy import Hierarchy
from kveil.operators.project import cap, select_roles, with_dense_id
from kveil.session import cut_lineage
from kveil.sources.config import Roles, load_spec
from kveil.sources.tables import read_table, write_csv


def anonymize(
    df: DataFrame,
    roles: Roles,
    hierarchy: Hierarchy,
    k: int,
    key: str = "id",
    level: str | int = "lca",
    block_rows: int = 1000,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The clustered table and its k-anonymous form; identifiers are left behind.

    Clusters come with their labels from where they are made; both tables are projections of one written table.
    """
    chosen = select_roles(df, roles, keep=[key])
    assigned = assign_clusters(chosen, roles, hierarchy, k, key, block_rows, seed, profiled=True)
    labelled = profiled_labels(assigned, roles, hierarchy, level)
    both = cut_lineage(chosen.join(labelled, F.col(quoted(key)).eqNullSafe(F.col("__key"))).drop("__key"))
    text = {a.name: F.col(quoted(f"__label__{a.name}")).alias(a.name) for a in roles.quasi}
    anonymous = both.select(*[text.get(c, F.col(quoted(c))) for c in chosen.columns])
    return both.select(*map(quoted, chosen.columns), "Cluster", "Info"), anonymous


def run_anonymize(
    spark: SparkSession,
    path: str,
    level: str | int = "lca",
    single_file: bool = False,
    seed: int = 0,
) -> dict[str, str]:
    """Runs the job file at ``path``; returns where its three tables went."""
    spec = load_spec(spark, path)
    hierarchy = Hierarchy.build(spec.dgh)
    chosen = select_roles(read_table(spark, spec.input_path), spec.roles)
    normal = cap(with_dense_id(chosen, order="input"), spec.cap)
    clustered, anonymous = anonymize(normal, spec.roles, hierarchy, spec.k, level=level, seed=seed)
    base = spec.output_path.rstrip("/")
    out = {n: f"{base}/{n}" for n in ("normal-table", "greedy-k-member-clustering", "k-anonymity")}
    write_csv(normal, out["normal-table"], single_file=single_file)
    write_csv(clustered.drop("Info"), out["greedy-k-member-clustering"], single_file=single_file)
    write_csv(anonymous.orderBy("id"), out["k-anonymity"], single_file=single_file)
    return out
